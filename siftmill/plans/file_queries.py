"""Queries on files, their groups and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions import columns as c
from siftmill.functions import fingerprints as fp
from siftmill.operators import dedup, graph, runs, store
from siftmill.operators.snapshots import completed_snapshots
from siftmill.plans.tables import read
from siftmill.shared import join_by_key, spread

# Folders left out in the path_exclusion query.
EXCLUDED = ("/data/lib00001/archive", "/data/lib00002/photos/", "/gdrive/lib00001", "/mnt")


class Tables:
    """The input tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read(self.spark, self.folder, name)

    @property
    def store(self):
        return self.scans, self.files, self.duplicate_groups, self.duplicate_members


_REGISTRY: dict[str, object] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _REGISTRY[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _case_mime(ending: str) -> str:
    return "case " + " ".join(f"when {ending} = '{k}' then '{v}'" for k, v in c.MIME_BY_ENDING.items()) + f" else '{c.DEFAULT_MIME}' end"


_BASE = "split_part(replace({p}, '\\', '/'), '/', -1)"
_NORM = "trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"
_MIME = "lower(trim(split_part(mime_type, ';', 1)))"
_DOCS = ", ".join(f"'{m}'" for m in c.DOCUMENT_MIMES)

# ------------------------------------------------------------------ files


@query("select id, size from files where size > 0")
def zero_byte_filter(t):
    return t.files.filter("size > 0").select("id", "size")


@query("select * exclude (minhash_signature), hex(minhash_signature) as minhash_signature from files where scan_id in (select max(id) from scans where phase = 'COMPLETE' group by archive_root)")
def scan_listing(t):
    last = t.scans.filter("phase = 'COMPLETE'").groupBy("archive_root").agg(F.max("id").alias("scan_id"))
    return t.files.join(last, "scan_id", "left_semi").withColumn("minhash_signature", F.hex("minhash_signature")).select(*t.files.columns)


@query("select id, path from files where " + " and ".join(f"not (path = '{r.rstrip('/')}' or starts_with(path, '{r.rstrip('/')}/'))" for r in EXCLUDED))
def path_exclusion(t):
    """The few roots are literals here, so the filter reaches the scan."""
    keep = F.lit(True)
    for root in EXCLUDED:
        keep = keep & ~c.is_under(F.col("path"), root)
    return t.files.filter(keep).select("id", "path")


@query(
    "select id, path from files where not exists (select 1 from scans s where files.path = s.archive_root "
    "or starts_with(files.path, s.archive_root || '/'))"
)
def archive_roots_excluded(t):
    return store.exclude_under(t.files, t.scans.select(F.col("archive_root").alias("root"))).select("id", "path")


@query(f"select id, {_case_mime('e')} as mime from (select id, lower(regexp_extract({_BASE.format(p='path')}, '\\.([A-Za-z0-9]+)$', 1)) as e from files)")
def mime_probe(t):
    return t.files.select("id", c.mime_of(F.col("path")).alias("mime"))


@query(
    f"select id, m as mime, case when m in ({_DOCS}) then 'document' when starts_with(m, 'image/') then 'image' else 'generic' end as handler, "
    f"case when starts_with(m, 'image/') then 'near-dup-image' else 'near-dup-document' end as strategy from (select id, {_MIME} as m from files)"
)
def handler_dispatch(t):
    m = c.clean_mime(F.col("mime_type"))
    return t.files.select("id", m.alias("mime"), c.handler_of(m).alias("handler"), c.near_dup_strategy(m).alias("strategy"))


@query(
    "select id, case when trim(b) <> '' and ("
    + " or ".join(f"regexp_matches(b, '{p}')" for p in c.COPY_PATTERNS)
    + f") then 'explicit_copy' end as copy_hint from (select id, {_BASE.format(p='path')} as b from files)"
)
def copy_hint(t):
    return store.hinted_copies(t.files)


@query("select distinct mime_type from files where mime_type is not null")
def distinct_mime(t):
    return t.files.select("mime_type").filter("mime_type is not null").distinct()


@query("select id, provider, case when size < 1024 then size || ' B' when size < 1048576 then printf('%.1f KB', floor(size / 1024.0 * 10 + 0.5) / 10) when size < 1073741824 then printf('%.1f MB', floor(size / 1048576.0 * 10 + 0.5) / 10) else printf('%.2f GB', floor(size / 1073741824.0 * 100 + 0.5) / 100) end as text from files")
def format_bytes(t):
    return t.files.select("id", "provider", c.format_bytes(F.col("size")).alias("text"))


@query(
    "select id, coalesce(case when len(p) > 3 then '…/' || p[-2] || '/' || p[-1] else path end, '') as short "
    "from (select id, path, string_split(rtrim(replace(path, '\\', '/'), '/'), '/') as p from files)"
)
def truncate_path(t):
    return t.files.select("id", c.short_path(F.col("path")).alias("short"))


# ------------------------------------------------------------------ exact duplicates


@query("select size, count(*) as n_files from files where size > 0 group by size having count(*) >= 2")
def size_groups(t):
    return dedup.size_groups(t.files)


@query(
    "select scan_id, size, lower(trim(hash_partial)) as hash_partial, count(*) as n_files, min(id) as first_id from files "
    "where hash_partial is not null and size > 0 group by 1, 2, 3 having count(*) >= 2"
)
def candidate_groups(t):
    return dedup.candidate_groups(t.files)


_EXACT = """
with f as (select *, lower(trim(hash_full)) as h from files where hash_full is not null and size > 0),
r as (select scan_id, size, h, id, path, count(*) over (partition by scan_id, size, h) as n,
      row_number() over (partition by scan_id, size, h order by modified_at nulls last, length(path), id) as r from f)
select scan_id, size, h as hash_full, n as n_files, id as keep_id, path as keep_path, (n - 1) * size as reclaimable_bytes
from r where r = 1 and n >= 2"""


@query(_EXACT)
def exact_groups(t):
    return dedup.exact_groups(t.files)


@query(
    "select id, min(id) over w as class_id, count(*) over w - 1 as n_links from (select *, lower(trim(hash_full)) as h from files where hash_full is not null and size > 0) "
    "window w as (partition by scan_id, size, h) qualify count(*) over w > 1"
)
def exact_links(t):
    return dedup.exact_links(t.files)


@query("select doc_id, sha256(encode(text)[1:4096]) as hash_partial, sha256(encode(text)) as hash_full, octet_length(encode(text)) as bytes from documents")
def content_hashes(t):
    raw = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", fp.partial_hash(raw).alias("hash_partial"), fp.full_hash(raw).alias("hash_full"), F.octet_length(raw).cast("long").alias("bytes"))


# ------------------------------------------------------------------ texts and signatures


@query(f"select doc_id, {_NORM.format(t='text')} as text from documents")
def normalise_text(t):
    return t.documents.select("doc_id", c.normalise_text(F.col("text")).alias("text"))


_SHINGLES = f"""
w as (select doc_id, lang, text, string_split({_NORM.format(t='text')}, ' ') as w from documents),
s as (select doc_id, lang, text, case when text is null or trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then []
      when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w)"""
_HASH = "coalesce(list_reduce(list_prepend(0::bigint, list_transform(string_split(x, ''), lambda ch: ascii(ch)::bigint)), lambda h, ch: (h * 31 + ch) & 4294967295), 0)"


@query(f"with {_SHINGLES}, e as (select doc_id, unnest(s) as x from s) select doc_id, x as shingle, {_HASH} as hash from e")
def shingle_hashes(t):
    return t.documents.select("doc_id", F.explode(c.shingles(F.col("text"))).alias("shingle")).withColumn("hash", fp.shingle_hash(F.col("shingle")))


_A, _B = fp.coefficients()
_SIGNATURES = f"""{_SHINGLES},
k(i, a, b) as (values {", ".join(f"({i}, {a}::bigint, {b}::bigint)" for i, (a, b) in enumerate(zip(_A, _B)))}),
e as (select doc_id, unnest(s) as x from s), h as (select doc_id, {_HASH} as x from e),
m as (select doc_id, i, min((a * x + b) % {fp.MODULUS}) as v from h cross join k group by doc_id, i),
g as (select doc_id, list(v order by i) as v from m group by doc_id),
sig as (select d.doc_id, d.lang, octet_length(encode(d.text)) as size, coalesce(g.v, list_transform(range({fp.PERMUTATIONS}), lambda i: {fp.NOTHING})) as v
        from documents d left join g on g.doc_id = d.doc_id)"""


@query(f"with {_SIGNATURES} select doc_id, sha256(array_to_string(v, ',')) as signature from sig")
def minhash_signatures(t):
    sig = fp.signature(F.col("text"))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", sig.alias("v")).select("doc_id", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256).alias("signature"))


@query(f"""with {_SIGNATURES},
cls as (select lang, size, v, min(doc_id) as id, count(*) as n from sig where lang is not null group by lang, size, v),
p as (select a.id as id_a, b.id as id_b, a.n as n_a, b.n as n_b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] = z[2])::int)) / 128.0::double as similarity
      from cls a join cls b on a.lang = b.lang and a.id < b.id and (2 * least(a.size, b.size) >= greatest(a.size, b.size) or least(a.size, b.size) <= 0))
select id_a, id_b, similarity::double as similarity, n_a, n_b from p where similarity >= 64 / 128.0 and similarity < 1""")
def neardup_links(t):
    """Near duplicates among documents of one language, from 64 of 128 positions: pairs of classes of copies;
    neardup_members says which documents a class holds."""
    return dedup.near_duplicate_classes(_signed_documents(t, F.col("lang")))


def _signed_documents(t, kind):
    docs = spread(t.documents.withColumn("kind", kind).filter("kind is not null and text is not null").select("doc_id", "kind", "text"))
    return docs.select(F.col("doc_id").alias("id"), "kind", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), fp.signature(F.col("text")).alias("sig"))


@query(f"with {_SIGNATURES} select doc_id, min(doc_id) over w as class_id, count(*) over w as n from sig where lang is not null and size is not null window w as (partition by lang, size, v)")
def neardup_members(t):
    """Each document that takes part in neardup_links with its class there, so that every link can be told by document."""
    return dedup.near_duplicate_members(_signed_documents(t, F.col("lang"))).withColumnRenamed("id", "doc_id")


@query(f"""with {_SIGNATURES},
cls as (select size, v, min(doc_id) as id, count(*) as n from sig where size is not null group by size, v),
p as (select a.id as id_a, b.id as id_b, a.n as n_a, b.n as n_b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] = z[2])::int)) / 128.0::double as similarity
      from cls a join cls b on a.id < b.id and (2 * least(a.size, b.size) >= greatest(a.size, b.size) or least(a.size, b.size) <= 0))
select id_a, id_b, similarity::double as similarity, n_a, n_b from p where similarity >= 64 / 128.0 and similarity < 1""")
def neardup_all_links(t):
    """Near duplicates among all documents with a text, whatever their language label, odd or null ones too, from 64 of
    128 positions: pairs of classes of copies, whose documents neardup_all_members names."""
    return dedup.near_duplicate_classes(_signed_documents(t, F.lit("document")))


@query(f"with {_SIGNATURES} select doc_id, min(doc_id) over w as class_id, count(*) over w as n from sig where size is not null window w as (partition by size, v)")
def neardup_all_members(t):
    """Each document with a text and its class in neardup_all_links."""
    return dedup.near_duplicate_members(_signed_documents(t, F.lit("document"))).withColumnRenamed("id", "doc_id")


@query(r"""select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(text, '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'gsi'), '<[a-zA-Z/!][^>]*>', ' ', 'gs'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g')) as text from documents""")
def markup_text(t):
    return t.documents.select("doc_id", c.strip_markup(F.col("text")).alias("text"))


@query("""
with f as (select id, minhash_signature as s from files where octet_length(minhash_signature) = 8),
m as (select distinct group_id, file_id from duplicate_members)
select m.group_id, m.file_id, 1 - bit_count(xor(('0x' || hex(a.s))::ubigint::bit, ('0x' || hex(b.s))::ubigint::bit)) / 64.0::double as similarity
from m join duplicate_groups g on g.id = m.group_id join f a on a.id = m.file_id join f b on b.id = g.canonical_file_id""")
def image_similarity(t):
    """Each image of a group against the group's canonical file, by difference hash."""
    f = t.files.filter(F.octet_length("minhash_signature") == 8).select("id", "minhash_signature")
    side = lambda k, s: f.select(F.col("id").alias(k), F.col("minhash_signature").alias(s))
    m = t.duplicate_members.select("group_id", "file_id").distinct().join(t.duplicate_groups.select(F.col("id").alias("group_id"), "canonical_file_id"), "group_id")
    return m.join(side("file_id", "a"), "file_id").join(side("canonical_file_id", "b"), "canonical_file_id").select("group_id", "file_id", fp.dhash_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"""
with c as (select {_MIME} as kind, hex(minhash_signature) as s, min(id) as id, count(*) as n from files where octet_length(minhash_signature) = 8 and mime_type is not null group by 1, 2),
p as (select a.id as id_a, b.id as id_b, 1 - bit_count(xor(('0x' || a.s)::ubigint::bit, ('0x' || b.s)::ubigint::bit)) / 64.0::double as similarity, a.n as n_a, b.n as n_b
      from c a join c b on a.kind = b.kind and a.id < b.id)
select * from p where similarity >= 0.9 and similarity < 1""")
def image_links(t):
    """Near-duplicate images of one media type by difference hash: pairs of classes of copies, named by image_members."""
    return dedup.image_links(t.files.select("id", c.clean_mime(F.col("mime_type")).alias("kind"), F.col("minhash_signature").alias("fp")))


@query(f"select id, min(id) over (partition by {_MIME}, minhash_signature) as class_id from files where octet_length(minhash_signature) = 8 and mime_type is not null")
def image_members(t):
    """Each image with a fingerprint and its class in image_links."""
    images = t.files.filter((F.octet_length("minhash_signature") == 8) & F.col("mime_type").isNotNull())
    keyed = images.select("id", F.concat_ws("/", F.hex("minhash_signature"), c.clean_mime(F.col("mime_type"))).alias("key"))
    classes = keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    return join_by_key(keyed, classes, "key", "n", keyed.count()).select("id", "class_id")


# ------------------------------------------------------------------ clusters

_LINKS = """
l as (select least(file_id_a, file_id_b) as a, greatest(file_id_a, file_id_b) as b, max(similarity) as similarity from scored_pairs
      where file_id_a <> file_id_b and similarity >= 0.5 and similarity < 1 group by 1, 2),
u as (select a, b from l union all select b, a from l),
reach(v, w) as (select a, a from u union select reach.v, u.b from reach join u on u.a = reach.w),
comp as (select v, min(w) as root from reach group by v)"""


@query(f"with recursive {_LINKS} select v as file_id, root as component from comp")
def components(t):
    links = dedup.scored_links(t.scored_pairs)
    return graph.components(links).select(F.col("v").alias("file_id"), F.col("root").alias("component"))


@query(f"""with recursive {_LINKS},
n as (select c.root, f.*, {_MIME} as m from comp c join files f on f.id = c.v),
h as (select root, first(id order by modified_at nulls last, length(path), id) as canonical, first(size order by modified_at nulls last, length(path), id) as csize,
             first(m order by modified_at nulls last, length(path), id) as cmime from n group by root),
p as (select n.root, n.id, n.size, canonical, csize, cmime, abs(ln(greatest(n.size, 1)) - ln(greatest(csize, 1))) as far from n join h using (root)
      where n.id = canonical or csize <= 0 or (n.size > 0 and 2 * least(n.size, csize) >= greatest(n.size, csize))),
q as (select *, min(size) over w as lo, max(size) over w as hi from p window w as (partition by root order by far, size range between unbounded preceding and current row)),
k as (select * from q where csize <= 0 or 2 * lo >= hi),
s as (select root, count(*) as n_members, first(canonical) as canonical_file_id, first(cmime) as cmime from k group by root having count(*) between 2 and 100),
x as (select ka.root, min(l.similarity) as least from l join k ka on ka.id = l.a join k kb on kb.id = l.b and kb.root = ka.root group by ka.root)
select root as group_id, case when starts_with(cmime, 'image/') then 'near-dup-image' else 'near-dup-document' end as strategy, canonical_file_id, n_members,
       coalesce(least, 0.0)::double as confidence, case when coalesce(least, 0) >= 0.95 then 'auto' else 'review' end as queue
from s left join x using (root)""")
def neardup_clusters(t):
    return dedup.near_duplicate_clusters(t.scored_pairs, t.files)


@query(f"""with recursive {_LINKS},
n as (select c.root, f.*, {_MIME} as m from comp c join files f on f.id = c.v),
h as (select root, first(id order by modified_at nulls last, length(path), id) as canonical, first(size order by modified_at nulls last, length(path), id) as csize,
             first(m order by modified_at nulls last, length(path), id) as cmime from n group by root),
p as (select n.root, n.id, n.size, canonical, csize, cmime, abs(ln(greatest(n.size, 1)) - ln(greatest(csize, 1))) as far from n join h using (root)
      where n.id = canonical or csize <= 0 or (n.size > 0 and 2 * least(n.size, csize) >= greatest(n.size, csize))),
q as (select *, min(size) over w as lo, max(size) over w as hi from p window w as (partition by root order by far, size range between unbounded preceding and current row)),
k as (select * from q where csize <= 0 or 2 * lo >= hi),
s as (select root, count(*) as n_members, first(canonical) as canonical_file_id, first(cmime) as cmime from k group by root having count(*) >= 2),
x as (select ka.root, min(l.similarity) as least from l join k ka on ka.id = l.a join k kb on kb.id = l.b and kb.root = ka.root group by ka.root)
select root as group_id, case when starts_with(cmime, 'image/') then 'near-dup-image' else 'near-dup-document' end as strategy, canonical_file_id, n_members,
       coalesce(least, 0.0)::double as confidence, case when n_members > 100 then 'oversize' when coalesce(least, 0) >= 0.95 then 'auto' else 'review' end as queue
from s left join x using (root)""")
def neardup_all_clusters(t):
    """The clusters of neardup_clusters and those of more than 100 members, in a queue of their own."""
    return dedup.near_duplicate_clusters(t.scored_pairs, t.files, oversize=True)


_STRATEGIES = f"""
s as (select *, coalesce(lower(trim(strategy)), 'unknown') as st from scored_pairs),
l as (select st, least(file_id_a, file_id_b) as a, greatest(file_id_a, file_id_b) as b, max(similarity) as similarity from s
      where file_id_a <> file_id_b and (st = 'exact-hash' or similarity >= 0.5 and similarity < 1) group by 1, 2, 3),
u as (select st, a, b from l union all select st, b, a from l),
reach(st, v, w) as (select st, a, a from u union select reach.st, reach.v, u.b from reach join u on u.a = reach.w and u.st = reach.st),
comp as (select st, v, min(w) as root from reach group by st, v),
n as (select c.st, c.root, f.* from comp c join files f on f.id = c.v),
h as (select st, root, first(id order by modified_at nulls last, length(path), id) as canonical, first(size order by modified_at nulls last, length(path), id) as csize from n group by st, root),
p as (select n.st, n.root, n.id, n.size, canonical, csize, abs(ln(greatest(n.size, 1)) - ln(greatest(csize, 1))) as far from n join h using (st, root)
      where n.st = 'exact-hash' or n.id = canonical or csize <= 0 or (n.size > 0 and 2 * least(n.size, csize) >= greatest(n.size, csize))),
q as (select *, min(size) over w as lo, max(size) over w as hi from p window w as (partition by st, root order by far, size range between unbounded preceding and current row)),
k as (select *, count(*) over (partition by st, root) as n_members from q where st = 'exact-hash' or csize <= 0 or 2 * lo >= hi),
e as (select * from k where n_members >= 2 and (st = 'exact-hash' or n_members <= 100)),
x as (select ka.st, ka.root, min(l.similarity) as least from l join k ka on ka.st = l.st and ka.id = l.a join k kb on kb.st = l.st and kb.id = l.b and kb.root = ka.root group by 1, 2)"""


@query(f"""with recursive {_STRATEGIES}
select distinct e.st as strategy, e.root as group_id, e.canonical as canonical_file_id, e.n_members, case when e.st = 'exact-hash' then 1.0 else coalesce(x.least, 0.0) end::double as confidence
from e left join x on x.st = e.st and x.root = e.root""")
def strategy_groups(t):
    """Exact and near-duplicate pairs clustered apart, each group with the strategy of its pairs."""
    return dedup.clusters_by_strategy(t.scored_pairs, t.files)[0]


@query(f"with recursive {_STRATEGIES} select st as strategy, root as group_id, id as file_id from e")
def strategy_members(t):
    return dedup.clusters_by_strategy(t.scored_pairs, t.files)[1]


# ------------------------------------------------------------------ runs, order, formats


@query("select id, run_label, phase, archive_root, row_number() over (order by created_at desc nulls last, id desc) as place from scans qualify place <= 1000")
def runs_newest_first(t):
    """The thousand newest runs in order: a top-k of one table, so no task sorts all of it."""
    return runs.newest(t.scans, 1000).select("id", "run_label", "phase", "archive_root", "place")


@query("select id, phase from scans where phase not in ('COMPLETE', 'FAILED', 'PURGED', 'CLEANED', 'STAGED') order by created_at desc nulls last, id desc limit 1")
def in_progress_run(t):
    return runs.in_progress(t.scans).select("id", "phase")


@query("select id as group_id, scan_id, confidence, row_number() over (partition by scan_id order by confidence nulls first, id) as place from duplicate_groups qualify place <= 100")
def groups_least_certain_first(t):
    """The hundred least certain groups of each run, in order."""
    return store.least_certain(t.duplicate_groups, 100).select(F.col("id").alias("group_id"), "scan_id", "confidence", "place")


@query("""select group_id, file_id, row_number() over (partition by group_id order by file_id is not distinct from canonical_file_id desc, file_id) as place
from (select distinct group_id, file_id, canonical_file_id from duplicate_members m join duplicate_groups g on g.id = m.group_id where file_id is not null) qualify place <= 500""")
def members_kept_first(t):
    """The first five hundred members of each group, the kept one ahead."""
    return store.kept_first(t.duplicate_groups, t.duplicate_members, 500).select("group_id", "file_id", "place")


_NOW = "timestamp '2024-06-01 00:00:00'"


@query(f"""select id, case when last_heartbeat is null then 'UNKNOWN' when s < 30 then 'RUNNING' when s < 300 then 'RESUMING' else 'INTERRUPTED' end as state,
case when s is null then null when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' else (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' end as age,
strftime(created_at, '%Y-%b-%d %H:%M:%S') as shown
from (select *, greatest(date_diff('second', date_trunc('second', last_heartbeat), {_NOW}), 0) as s from scans)""")
def run_liveness(t):
    """Heartbeat state and age as of a stated time, and the start as it is shown."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    beat = F.col("last_heartbeat")
    return t.scans.select("id", runs.heartbeat_state(beat, now).alias("state"), c.age(runs.seconds_since(beat, now)).alias("age"), c.display_date(F.col("created_at")).alias("shown"))


@query("select id, case when strategy = 'exact-hash' then 'success' when confidence >= 0.8 then 'contrast' else 'error' end as badge, round(confidence * 100)::bigint || '%' as percent from duplicate_groups where confidence is not null and round(confidence * 1000) % 10 <> 5")
def confidence_badges(t):
    """Badges and percents; percents half-way between two are left out as the engines round them apart."""
    g = t.duplicate_groups.filter("confidence is not null and round(confidence * 1000) % 10 <> 5")
    return g.select("id", c.confidence_badge(F.col("strategy"), F.col("confidence")).alias("badge"), c.percent(F.col("confidence")).alias("percent"))


@query("select id, '0.95|0.5' as settings, 'run_' || strftime(created_at, '%Y%m%d_%H%M%S') as label from scans where created_at is not null")
def run_labels(t):
    s = t.scans.filter("created_at is not null")
    return s.select("id", c.settings_fingerprint(F.lit(0.95), F.lit(0.5)).alias("settings"), c.run_label(F.col("created_at")).alias("label"))


@query("select m.group_id, m.file_id, (a.hash_full = b.hash_full)::int::double as similarity from (select distinct group_id, file_id from duplicate_members) m join duplicate_groups g on g.id = m.group_id join files a on a.id = m.file_id join files b on b.id = g.canonical_file_id where a.hash_full is not null and b.hash_full is not null")
def equality_similarity(t):
    """The similarity of types without one of their own: 1 for equal content, else 0."""
    f = t.files.filter("hash_full is not null")
    m = t.duplicate_members.select("group_id", "file_id").distinct().join(t.duplicate_groups.select(F.col("id").alias("group_id"), "canonical_file_id"), "group_id")
    side = lambda k, h: f.select(F.col("id").alias(k), F.col("hash_full").alias(h))
    return m.join(side("file_id", "a"), "file_id").join(side("canonical_file_id", "b"), "canonical_file_id").select("group_id", "file_id", fp.equality_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("select id as group_id, coalesce(confidence, 0) >= 0.95 as is_auto, case strategy when 'exact-hash' then 'Exact' when 'near-dup-image' then 'Image' when 'near-dup-document' then 'Document' else strategy end as label from duplicate_groups")
def group_labels(t):
    return t.duplicate_groups.select(F.col("id").alias("group_id"), (F.coalesce("confidence", F.lit(0.0)) >= 0.95).alias("is_auto"), c.strategy_label(F.col("strategy")).alias("label"))


# ------------------------------------------------------------------ incremental scans


@query("select id, path, size, modified_at, hash_full from files qualify row_number() over (partition by path order by id desc) = 1")
def latest_by_path(t):
    return store.latest_by_path(t.files).select("id", "path", "size", "modified_at", "hash_full")


_TURNS = """
s as (select id as scan_id, archive_root, row_number() over (partition by archive_root order by created_at, id) as k,
      count(*) over (partition by archive_root) as n from scans where phase = 'COMPLETE')"""


@query(f"""with {_TURNS},
cur as (select * from files where scan_id in (select scan_id from s where k = n)),
old as (select * from files where scan_id in (select scan_id from s where k < n) qualify row_number() over (partition by path order by id desc) = 1),
j as (select cur.id, cur.path, old.hash_partial as p, old.hash_full as f, coalesce(old.hash_partial is not null and cur.size = old.size
      and date_trunc('second', cur.modified_at) = date_trunc('second', old.modified_at), false) as reused from cur left join old on cur.path = old.path)
select id, path, reused, case when reused then p end as hash_partial, case when reused then f end as hash_full from j""")
def incremental_reuse(t):
    """Files of each root's last completed scan against the latest rows of all earlier ones."""
    turns = completed_snapshots(t.scans)
    last = turns.groupBy("series").agg(F.max_by("scan_id", "turn").alias("scan_id"))
    current = t.files.join(last, "scan_id", "left_semi")
    before = t.files.join(turns.join(last, "scan_id", "left_anti"), "scan_id", "left_semi")
    return store.reuse_fingerprints(current, before)


@query(f"""with {_TURNS},
f as (select archive_root, k, path, size, date_trunc('second', modified_at) as sec from files join s using (scan_id) where path is not null
      qualify row_number() over (partition by archive_root, k, path order by files.id desc) = 1),
d as (select coalesce(a.archive_root, b.archive_root) as archive_root, coalesce(a.k, b.k + 1) as k, count(*) as c from f a full join f b on a.archive_root = b.archive_root and a.k = b.k + 1 and a.path = b.path
      where a.path is null or b.path is null or a.size is distinct from b.size or a.sec is distinct from b.sec group by 1, 2)
select s.scan_id, coalesce(c, 0) as n_changes, coalesce(c, 0) = 0 as unchanged from s left join d on d.archive_root = s.archive_root and d.k = s.k where s.k > 1""")
def unchanged_scans(t):
    return store.unchanged_scans(t.files, t.scans)


# ------------------------------------------------------------------ previews, reports, plans

_MEMBERS = """
m as (select distinct dm.group_id, dm.file_id, g.scan_id, g.canonical_file_id, g.strategy, g.confidence
      from duplicate_members dm join duplicate_groups g on g.id = dm.group_id)"""


@query(f"""with {_MEMBERS},
n as (select scan_id, count(*) as total_files from files group by 1),
g as (select scan_id, count(*) as total_groups, count(*) filter (strategy = 'exact-hash') as exact_groups, count(*) filter (strategy <> 'exact-hash') as near_dup_groups,
      avg(confidence) as avg_confidence, count(*) filter (confidence >= 0.95) as auto_queue, count(*) filter (confidence < 0.95) as review_queue from duplicate_groups group by 1),
d as (select x.scan_id, count(*) as total_dupes, coalesce(sum(size), 0)::bigint as reclaimable_bytes from (select distinct scan_id, file_id from m where file_id <> canonical_file_id) x left join files f on f.id = x.file_id group by 1)
select s.id as scan_id, coalesce(total_files, 0) as total_files, coalesce(total_groups, 0) as total_groups, coalesce(exact_groups, 0) as exact_groups, coalesce(near_dup_groups, 0) as near_dup_groups,
       coalesce(auto_queue, 0) as auto_queue, coalesce(review_queue, 0) as review_queue, coalesce(total_dupes, 0) as total_dupes, coalesce(reclaimable_bytes, 0) as reclaimable_bytes, round(coalesce(avg_confidence, 0.0), 9) as avg_confidence
from scans s left join n on n.scan_id = s.id left join g on g.scan_id = s.id left join d on d.scan_id = s.id""")
def preview_summary(t):
    out = store.preview_summary(*t.store)
    return out.withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"""with {_MEMBERS},
p as (select m.group_id, count(*) as member_count, coalesce(sum(case when m.file_id <> m.canonical_file_id then f.size else 0 end), 0)::bigint as reclaimable_bytes, coalesce(sum(f.size), 0)::bigint as total_bytes
      from m join files f on f.id = m.file_id group by 1)
select g.id as group_id, g.scan_id, g.strategy, g.confidence, g.canonical_file_id, member_count, member_count - 1 as dupe_count, reclaimable_bytes, total_bytes, k.path as canonical_path, k.mime_type as canonical_mime_type
from duplicate_groups g join p on p.group_id = g.id left join files k on k.id = g.canonical_file_id""")
def preview_groups(t):
    return store.preview_groups(t.files, t.duplicate_groups, t.duplicate_members)


_ARCHIVE = """coalesce(s.archive_root, '') || '/run_' || m.scan_id || case when regexp_matches(replace(f.path, '\\', '/'), '^[A-Za-z]:/') then '/' || f.path[1] else '' end
|| '/' || regexp_replace(replace(f.path, '\\', '/'), '^([A-Za-z]:)?/+', '')"""


@query(f"""with {_MEMBERS}
select m.group_id, m.file_id, f.path, f.size, f.modified_at, f.mime_type, coalesce(m.file_id = m.canonical_file_id, false) as is_canonical,
       case when not coalesce(m.file_id = m.canonical_file_id, false) then {_ARCHIVE} end as archive_path
from m join files f on f.id = m.file_id join scans s on s.id = m.scan_id""")
def preview_members(t):
    return store.preview_members(*t.store)


@query(f"""with {_MEMBERS}
select m.scan_id, m.group_id, m.file_id, f.path as source, {_ARCHIVE} as destination
from m join files f on f.id = m.file_id join scans s on s.id = m.scan_id where not coalesce(m.file_id = m.canonical_file_id, false)""")
def archive_plan(t):
    return store.archive_plan(*t.store)


@query(f"""with {_MEMBERS},
n as (select scan_id, count(*) as n_files, sum(size)::bigint as total_bytes from files group by 1),
g as (select scan_id, count(*) as n_groups from duplicate_groups group by 1),
r as (select m.scan_id, sum(f.size)::bigint as recoverable_bytes, count(*) filter (f.copy_hint = 'explicit_copy') as explicit_copies from m join files f on f.id = m.file_id where m.file_id is distinct from m.canonical_file_id group by 1),
a as (select scan_id, count(distinct id) as staged from actions where upper(trim(action_type)) = 'MOVE' group by 1)
select s.id as scan_id, coalesce(n_files, 0) as n_files, coalesce(total_bytes, 0) as total_bytes, coalesce(n_groups, 0) as n_groups, coalesce(recoverable_bytes, 0) as recoverable_bytes, coalesce(explicit_copies, 0) as explicit_copies, coalesce(staged, 0) as staged
from scans s left join n on n.scan_id = s.id left join g on g.scan_id = s.id left join r on r.scan_id = s.id left join a on a.scan_id = s.id""")
def report_totals(t):
    return store.report_totals(*t.store, t.actions)


@query("""select s.id as scan_id, run_label, phase, (select count(*) from files f where f.scan_id = s.id) as n_files, (select count(*) from duplicate_groups g where g.scan_id = s.id) as n_groups from scans s""")
def run_history(t):
    return store.run_history(t.scans, t.files, t.duplicate_groups)


@query("select * from scans where phase = 'COMPLETE' qualify row_number() over (partition by archive_root order by created_at desc, id desc) = 1")
def latest_complete_runs(t):
    best = t.scans.filter("phase = 'COMPLETE'").groupBy("archive_root").agg(F.max_by(F.struct(*(x for x in t.scans.columns if x != "archive_root")), F.struct("created_at", "id")).alias("r"))
    return best.select("archive_root", "r.*").select(*t.scans.columns)


@query("""select group_id, count(*) as n_members, string_agg(file_id, ',' order by file_id) as members from (select distinct group_id, file_id from duplicate_members) where group_id in (select id from duplicate_groups) group by 1""")
def groups_with_members(t):
    whole = store.groups_with_members(t.duplicate_groups, t.duplicate_members).filter("members is not null")
    return whole.select(F.col("id").alias("group_id"), F.size("members").cast("long").alias("n_members"), F.array_join(F.transform("members", lambda m: m.file_id.cast("string")), ",").alias("members"))


@query(f"""with {_MEMBERS}, g as (select id, row_number() over (partition by scan_id order by id) as i from duplicate_groups)
select m.scan_id as run_id, s.run_label, g.i as group_index, m.strategy, printf('%.4f', floor(coalesce(m.confidence, 0) * 10000 + 0.5) / 10000) as confidence, case when m.file_id = m.canonical_file_id then 'canonical' else 'duplicate' end as role,
       '"' || replace(f.path, '"', '""') || '"' as path, f.size from m join g on g.id = m.group_id join files f on f.id = m.file_id join scans s on s.id = m.scan_id""")
def results_rows(t):
    return store.results_rows(*t.store)


@query("select id, scan_id, file_id, original_path, destination from actions where upper(trim(action_type)) = 'MOVE' and not coalesce(cleaned, false) and not coalesce(purged, false)")
def movable_back(t):
    return store.movable_back(t.actions).select("id", "scan_id", "file_id", "original_path", "destination")


@query("select id, case when scan_id = 1 then true else cleaned end as cleaned from actions")
def marked_cleaned(t):
    return store.mark(t.actions, 1, "cleaned").select("id", "cleaned")


@query("select g.id, count(m.file_id) as n from duplicate_groups g left join duplicate_members m on m.group_id = g.id where g.confidence >= 0.6 group by 1")
def dismissed_groups(t):
    """Groups and members after dismissing those of low or unknown confidence."""
    low = t.duplicate_groups.filter("confidence is null or confidence < 0.6").select(F.col("id").alias("group_id"))
    groups, members = store.dismiss(t.duplicate_groups, t.duplicate_members, low)
    n = members.groupBy(F.col("group_id").alias("id")).agg(F.count("file_id").alias("n"))
    return groups.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""select id, case when s >= 3600 then printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then printf('%dm %ds', s // 60, s % 60) else s || 's' end as took
from (select id, date_diff('second', date_trunc('second', created_at), date_trunc('second', completed_at)) as s from scans where completed_at is not null and created_at is not null)""")
def run_durations(t):
    s = F.timestamp_diff("SECOND", F.date_trunc("SECOND", F.col("created_at")), F.date_trunc("SECOND", F.col("completed_at")))
    return t.scans.filter("completed_at is not null and created_at is not null").select("id", c.duration(s).alias("took"))


@query("""select scan_id, id, executed_at, date_diff('microsecond', lag(executed_at) over w, executed_at) as gap_us from actions where executed_at is not null window w as (partition by scan_id order by executed_at, id)""")
def action_gaps(t):
    w = Window.partitionBy("scan_id").orderBy("executed_at", "id")
    return t.actions.filter("executed_at is not null").select("scan_id", "id", "executed_at", F.timestamp_diff("MICROSECOND", F.lag("executed_at").over(w), F.col("executed_at")).alias("gap_us"))
