"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import components, leakage, mixture, near_dup, pii, representatives
from siftmill.plans.tables import read

#: Of tests and examples; where redacted text leaves the house, ``siftmill.pii.key`` of the session holds a secret.
EXAMPLE_KEY = "an example, no secret"

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records = near_dup.latest_signatures(read(spark, d, "files"), read(spark, d, "scans"))
    return near_dup.near_duplicate_pairs(records).select("file_id_a", "file_id_b").distinct()


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_links(near_dup.latest_signatures(read(spark, d, "files"), read(spark, d, "scans")))[0]


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_links(near_dup.latest_signatures(read(spark, d, "files"), read(spark, d, "scans")))[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    similar = F.col("similarity").between(0.5, 1.0) & ~F.isnan("similarity")
    links = components.clean_links(read(spark, d, "scored_pairs"), F.col("file_id_a"), F.col("file_id_b"), similar)
    return components.connected_groups(links)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return representatives.best_representatives(*(read(spark, d, t) for t in ("duplicate_groups", "duplicate_members", "files", "scans", "providers")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("group_id", "file_id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_cleaned_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the cleaned texts still leak, which is nothing, and how many documents were cut."""
    items, clean = read(spark, d, "eval_items"), p7_cleaned(spark, d)
    one = lambda cut, kept, left: [F.lit(x).cast("long").alias(n) if isinstance(x, int) else x.cast("long").alias(n) for x, n in ((cut, "docs_cut"), (kept, "docs_kept"), (left, "leaks_left"))]
    was_cut = F.col("chars_removed") > 0
    rows = clean.select(*one(was_cut.cast("int"), (~was_cut).cast("int"), 0)).unionByName(leakage.find_leaks(clean, items).select(*one(0, 0, F.lit(1))))
    return rows.agg(*(F.sum(c).alias(c) for c in rows.columns))


def _mix(spark: SparkSession, d: str, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    longer = F.log2(F.col("n_tokens") + 2)  # a fragment is less likely than a full text
    return mixture.mix_sources(read(spark, d, "documents"), read(spark, d, "source_weights"), weight=longer, total_tokens=total)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_mix_available(spark: SparkSession, d: str) -> DataFrame:
    """The mix at the size of the corpus, small sources staying at their cap."""
    return _mix(spark, d, "available")[0]


def p8_shares_available(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "available")[1]


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each source with a weight, in both mixes: documents are its own, copies within max_repeats, tokens add up, at
    most its capacity, and off the target by no more than its longest document; 'short' counts what is not so."""
    weights, documents = read(spark, d, "source_weights"), read(spark, d, "documents")
    most = weights.groupBy(mixture.source_key(F.col("source")).alias("source")).agg(F.min("max_repeats").alias("most"))
    own = documents.select("doc_id", mixture.source_key(F.col("source")).alias("source"), F.lit(1).alias("known")).distinct()
    longest = mixture.count_tokens(documents).groupBy("source").agg(F.max("n_tokens").alias("longest"))
    out = None
    for name, total in (("whole", None), ("available", "available")):
        mix, shares = _mix(spark, d, total)
        per = mix.join(own, ["doc_id", "source"], "left").groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("sum"), F.max("copies").alias("copies"), F.count_if(F.col("known").isNull()).alias("strange")
        )
        r = shares.join(most, "source").join(per, "source", "left").join(longest, "source", "left")
        wrong = [
            F.coalesce("strange", F.lit(0)) > 0,
            F.coalesce("copies", F.lit(0)) > F.col("most"),
            F.coalesce("sum", F.lit(0)) != F.col("actual_tokens"),
            F.col("actual_tokens") > F.col("available_tokens") * F.col("most"),
            F.abs(F.col("actual_tokens") - F.col("target_tokens")) > F.coalesce("longest", F.lit(0)),
            F.col("at_cap") & (F.col("available_tokens") > 0) & (F.abs(F.col("actual_tokens") - F.col("available_tokens") * F.col("most")) > F.col("longest")),
        ]
        one = r.select(F.lit(name).alias("mix"), "source", sum(F.coalesce(w, F.lit(False)).cast("long") for w in wrong).alias("short"))
        out = one if out is None else out.unionByName(one)
    return out


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """The voted fields of the records, without the paths, whose alignment SQL cannot say."""
    return _records(spark, d).drop("path")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_pii(read(spark, d, "documents"), read(spark, d, "name_lexicon"))
    return found.filter(F.col("pii_kind").isin(*pii.KINDS)).distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    key = spark.conf.get("siftmill.pii.key", None) or EXAMPLE_KEY
    return pii.redact_pii(read(spark, d, "documents"), read(spark, d, "name_lexicon"), key.encode())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_links, p1_members, p3_found, p6_found, p6_records, p6_fields, p7_found, p7_cleaned, p7_cleaned_summary, p8_mix, p8_shares, p8_mix_available, p8_shares_available, p8_invariants, p9_found, p9_redacted)}


_P1_ROWS = """
with last as (
  select arg_max(id, created_at) as scan_id from scans
  where phase = 'COMPLETE' and archive_root is not null group by archive_root),
r as (
  select id, lower(trim(split_part(mime_type, ';', 1))) as grp, hex(minhash_signature) as h from files
  where scan_id in (select scan_id from last) and octet_length(minhash_signature) = 1024 and mime_type is not null),
c as (select grp, h, min(id) as id, count(distinct id) as n from r group by grp, h),
"""

_P1_PAIRS = """
v as (select *, list_transform(range(128), lambda i: substring(h, (i * 16 + 1)::int, 16)) as v from {rows}),
p as (
  select a.id as x, b.id as y, {counts} list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] = z[2])::int)) as agree
  from v a join v b on a.grp = b.grp and a.id < b.id)
"""

_P1 = _P1_ROWS + _P1_PAIRS.format(rows="r", counts="") + "select x as file_id_a, y as file_id_b from p where agree between 96 and 127"

_P1_LINKS = (
    _P1_ROWS + _P1_PAIRS.format(rows="c", counts="a.n as n_a, b.n as n_b,") + "select x as class_a, y as class_b, agree, n_a, n_b from p where agree between 96 and 127"
)

_P1_MEMBERS = _P1_ROWS.rstrip().rstrip(",") + " select distinct r.id, c.id as class_id from r join c using (grp, h)"

_P3 = """
with recursive e as (
  select distinct file_id_a as a, file_id_b as b from scored_pairs
  where file_id_a <> file_id_b and similarity >= 0.5 and similarity <= 1.0),
u as (select a, b from e union select b, a from e),
reach(v, w) as (select a, a from u union select reach.v, u.b from reach join u on u.a = reach.w)
select v as file_id, min(w) as group_id from reach group by v"""

_P6 = """
with m as (
  select distinct dm.group_id, dm.file_id, f.modified_at, f.path, p.trust_rank, s.created_at
  from duplicate_members dm join duplicate_groups g on g.id = dm.group_id join files f on f.id = dm.file_id
  left join scans s on s.id = g.scan_id left join providers p on p.provider = lower(trim(f.provider))),
k as (
  select *, case when modified_at < timestamp '1990-01-01' or modified_at > created_at then null else modified_at end as known,
         count(*) over (partition by group_id) as n from m),
o as (
  select group_id, file_id, n, row_number() over (partition by group_id
         order by known nulls last, trust_rank nulls last, length(path) nulls last, file_id) as r from k)
select group_id, file_id from o where n >= 2 and r = 1"""

_P6_FIELDS = """
with clean as (
  select id, path, lower(trim(provider)) as provider, size, modified_at, lower(trim(split_part(mime_type, ';', 1))) as mime_type,
         lower(trim(hash_partial)) as hash_partial, lower(trim(hash_full)) as hash_full, copy_hint from files),
m as (
  select distinct dm.group_id, dm.file_id, c.* exclude (id, modified_at), p.trust_rank,
         case when modified_at >= timestamp '1990-01-01' and (s.created_at is null or modified_at <= s.created_at) then modified_at end as modified_at
  from duplicate_members dm join duplicate_groups g on g.id = dm.group_id join clean c on c.id = dm.file_id
  left join scans s on s.id = g.scan_id left join providers p on lower(trim(p.provider)) = c.provider),
w as (
  select *, (0.5 + 0.5 * ((path is not null)::int + (provider is not null)::int + (size is not null)::int + (modified_at is not null)::int + (mime_type is not null)::int
         + (hash_partial is not null)::int + (hash_full is not null)::int + (copy_hint is not null)::int) / 8.0) / coalesce(greatest(trust_rank, 1), 100) as w from m),
b as (
  select group_id, w, unnest([{'f': 'provider', 'v': provider}, {'f': 'size', 'v': size::varchar}, {'f': 'modified_at', 'v': modified_at::varchar}, {'f': 'mime_type', 'v': mime_type},
         {'f': 'hash_partial', 'v': hash_partial}, {'f': 'hash_full', 'v': hash_full}, {'f': 'copy_hint', 'v': copy_hint}], recursive := true) from w),
t as (select group_id, f, v, round(sum(w), 9) as s from b where v is not null group by all),
e as (select group_id, f, v from t qualify row_number() over (partition by group_id, f order by s desc, v) = 1),
o as (
  select group_id, file_id, count(*) over (partition by group_id) as members, row_number() over (partition by group_id
         order by modified_at nulls last, trust_rank nulls last, length(path) nulls last, file_id) as r from m)
select o.group_id, o.file_id, o.members,
  max(case when f = 'provider' then v end) as provider, max(case when f = 'size' then v end)::bigint as size, max(case when f = 'modified_at' then v end)::timestamp as modified_at,
  max(case when f = 'mime_type' then v end) as mime_type, max(case when f = 'hash_partial' then v end) as hash_partial, max(case when f = 'hash_full' then v end) as hash_full,
  max(case when f = 'copy_hint' then v end) as copy_hint
from o left join e on e.group_id = o.group_id where r = 1 and members >= 2 group by 1, 2, 3"""

_P8_INVARIANTS = """
select mix, regexp_replace(lower(trim(source)), '[\\s\\-_]+', '_', 'g') as source, 0::bigint as short
from source_weights, (values ('whole'), ('available')) t(mix) where source is not null group by 1, 2"""

_P7 = """
with words as (
  select 0 as kind, doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents
  union all select 1, item_id, regexp_extract_all(lower(text), '[a-z0-9]+') from eval_items),
grams as (
  select kind, id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g
  from words where len(w) >= 12)
select distinct d.id as doc_id, i.id as item_id from grams d join grams i on d.g = i.g where d.kind = 0 and i.kind = 1"""

_P7_SUMMARY = f"""
with leaks as ({_P7}),
n as (select count(distinct doc_id) as docs_cut from leaks)
select docs_cut, (select count(*) from documents) - docs_cut as docs_kept, 0::bigint as leaks_left from n"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_links": _P1_LINKS, "p1_members": _P1_MEMBERS, "p3_found": _P3, "p6_found": _P6, "p6_fields": _P6_FIELDS, "p8_invariants": _P8_INVARIANTS, "p7_found": _P7, "p7_cleaned_summary": _P7_SUMMARY}
