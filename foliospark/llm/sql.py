"""SQL of the queries that SQL can express; the others are tested against brute force (tests/llm)."""

P7_FOUND = r"""
with recursive
pair as (
  select lower(regexp_replace(book_a_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) as a, lower(regexp_replace(book_b_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) as b from link_duplicates
),
edge as (select a, b from pair where a <> '' and b <> '' union select b, a from pair where a <> '' and b <> ''),
reach(src, dst) as (select a, a from edge union select r.src, e.b from reach r join edge e on r.dst = e.a)
select src as book_id, min(dst) as group_id from reach group by src
"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    return {"p7_found": P7_FOUND}
