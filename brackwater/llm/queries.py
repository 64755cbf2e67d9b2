"""Queries of the text operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brackwater.llm import copies, mixing, spans, tokenizer
from brackwater.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def _roundtrip(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every text decoded from its token ids."""
    return tokenizer.decoded(tokenizer.ids(documents))


def queries() -> dict[str, Query]:
    def over(function: Callable[..., DataFrame], *names: str) -> Query:
        return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names])

    return {
        "p1_found": over(copies.grouped, "upload_records"),
        "p1_collapsed": over(copies.collapsed, "upload_records"),
        "p1_st_copies": over(lambda df: copies.grouped(df, text="st", fields=copies.ST_FIELDS), "upload_records"),
        "p1_event_copies": over(lambda df: copies.grouped(df, text="event_raw", fields=()), "upload_records"),
        "p8_ids": over(tokenizer.ids, "documents"),
        "p8_decoded": over(_roundtrip, "documents"),
        "p9_shares": over(mixing.shares, "documents", "mix_targets"),
        "p9_mixture": over(mixing.mixture, "documents", "mix_targets"),
        "p10_found": over(spans.found, "documents"),
        "p10_shares": over(spans.shares, "documents"),
    }


def _copies_sql(column: str, names: tuple[str, ...]) -> str:
    """Groups of equal records: fields and values normalised by regular expressions, put in order and compared as a whole."""
    named = rf"(?i)(?:^|[,;|\n\t])[\p{{Ps}}\p{{Pi}}\"''<\s\pZ]*({'|'.join(names)})[\p{{Pe}}\p{{Pf}}\"''>\s\pZ]*(?:->|=|:)"
    marked = f"regexp_replace({column}, '{named}', chr(1) || '\\1' || chr(2), 'g')" if names else f"chr(1) || chr(2) || {column}"
    signed = rf"regexp_replace({marked}, '([^\p{{L}}\p{{N}}])-([0-9])', '\1' || chr(3) || '\2', 'g')"
    pointed = rf"regexp_replace({signed}, '([0-9])\.([0-9])', '\1' || chr(4) || '\2', 'g')"
    kept = rf"lower(regexp_replace({pointed}, '[^\p{{L}}\p{{N}}\p{{M}}\x01-\x04]+', '', 'g'))"
    plain = "case when starts_with(x, 'ts' || chr(2)) then translate(x, chr(3) || chr(4), '') else x end"
    return f"""n as (select record_id, {kept} as t from upload_records where {column} is not null and record_id is not null),
f as (select record_id, list_sort(list_transform(string_split(t, chr(1))[2:], lambda x: {plain})) as fields from n where contains(t, chr(1))),
g as (select fields, min(record_id) as kept_id from f group by 1),
c as (select distinct kept_id, record_id as copy_id from f join g using (fields) where kept_id <> record_id)"""


_SPANS = """d as (select doc_id, text from documents where doc_id is not null and length(text) >= 200),
w as (select doc_id, at_, substring(text, at_ + 1, 200) as span from (select doc_id, text, unnest(range(0, length(text) - 199)) as at_ from d)),
s as (select span from w group by 1 having min(doc_id) < max(doc_id)),
p as (select distinct doc_id, at_ from w join s using (span)),
l as (select *, case when at_ - lag(at_) over (partition by doc_id order by at_) <= 200 then 0 else 1 end as fresh from p),
i as (select *, sum(fresh) over (partition by doc_id order by at_ rows unbounded preceding) as no from l),
found as (select doc_id, min(at_) as span_start, max(at_) - min(at_) + 200 as span_chars from i group by doc_id, no)"""


def oracle_sql() -> dict[str, str]:
    pairs = "select kept_id, copy_id from c"
    return {
        "p1_found": f"with {_copies_sql('full_text', copies.FIELDS)} {pairs}",
        "p1_collapsed": f"""with {_copies_sql('full_text', copies.FIELDS)}
select distinct record_id as kept_id, 1 + (select count(*) from c where c.kept_id = u.record_id) as n_copies from upload_records u where record_id is not null and record_id not in (select copy_id from c)""",
        "p1_st_copies": f"with {_copies_sql('st', copies.ST_FIELDS)} {pairs}",
        "p1_event_copies": f"with {_copies_sql('event_raw', ())} {pairs}",
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p10_found": f"with {_SPANS} select doc_id, span_start, span_chars from found",
        "p10_shares": f"""with {_SPANS}, n as (select doc_id, max(coalesce(length(text), 0)) as n_chars from documents where doc_id is not null group by 1),
g as (select doc_id, sum(span_chars)::bigint as shared from found group by 1)
select doc_id, n_chars, coalesce(shared, 0) as shared_chars, case when n_chars > 0 then coalesce(shared, 0) / n_chars else 0.0 end as shared_share from n left join g using (doc_id)""",
    }
