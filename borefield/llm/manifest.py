"""Merkle dataset manifest: a tree of digests for each source, one over the sources, and a proof for each row.

Rows are numbered inside their source by a range-partitioned sort, and sixteen consecutive nodes at a time are folded to
their parent, level by level; every level is written as the node table, one row a run: (tree, run, members). A leaf's proof
needs the siblings at its coordinates (tree, level, place), which follow from its index and the number of leaves. All leaves
of a run share the coordinates above it, so paths are handed down: from the root, each node's children explode the
coordinates of their siblings, which are looked up in the node table by (tree, run), put in order, and set before the path of
the parent. So both sides of every join have each key once, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
#: The tree over the sources; a source's tree has the number of its first row.
TOP = -1
#: Bytes of source names that are broadcast; more are joined by a shuffle.
NAMES_BYTES = 32 << 20
_DIGEST = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(*(field(c) for c in columns))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `number`: their place, from 0, in a total order; every part counts on from the parts before it."""
    local = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"part": F.shiftright(local, 33), "within": local.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted(placed.groupBy("part").agg(F.count("*")).collect())  # as many rows as the sort has parts
    starts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    known = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.join(F.broadcast(known), "part").withColumn("number", F.col("start") + F.col("within")).drop("part", "within", "start")


def _runs(nodes: DataFrame) -> DataFrame:
    """The node table's rows of one level: each run of trees that have several nodes, its members in order."""
    member = F.struct("at", "hash", "doc_id", "altered")
    return nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / RUN).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("n").alias("n"))


def _parents(runs: DataFrame) -> DataFrame:
    none = F.lit(None)
    return runs.select(
        "tree", F.col("run").alias("at"), digest(F.array_join("members.hash", "")).alias("hash"), none.cast("long").alias("doc_id"), none.cast("string").alias("altered"),
        F.ceil(F.col("n") / RUN).alias("n"),
    )


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(the node table by level, the roots of the trees that end at each level); the largest tree has `most` leaves."""
    levels, roots = [], [nodes.where("n = 1")]
    while most > 1:
        levels.append(materialize(_runs(nodes)))
        nodes = _parents(levels[-1])
        roots.append(nodes.where("n = 1"))
        most = -(-most // RUN)
    return levels, roots


def _coordinates(at: Column, n: Column) -> Column:
    """Places of a node's siblings, from its place and how many nodes its level has: the rest of its run of sixteen."""
    first = at - at % RUN
    return F.filter(F.sequence(first, F.least(first + RUN, n) - 1), lambda place: place != at)


def _children(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """The members of runs with their paths: siblings looked up by coordinate, in order, then the parent's path.

    A path is one string of digests; `steps` says for each level how many of them stand before and after the node.
    """
    found = runs.join(parents.withColumnRenamed("at", "run"), ["tree", "run"])
    each = found.select("*", F.explode("members").alias("own")).withColumn("siblings", _coordinates(F.col("own.at"), F.col("n")))
    looked_up = F.transform("siblings", lambda place: F.get(F.col("members"), (place % RUN).cast("int")).hash)
    before = (F.col("own.at") % RUN).cast("int")
    step = F.struct(before.alias("before"), (F.size("siblings") - before).alias("after"))
    return each.select(
        "tree", F.col("own.at").alias("at"), F.col("own.hash").alias("hash"), F.col("own.doc_id").alias("doc_id"), F.col("own.altered").alias("altered"), "subroot",
        F.concat(F.array_join(looked_up, ""), F.col("path")).alias("path"), F.concat(F.array(step), F.col("steps")).alias("steps"),
    )


def _descend(levels: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """Paths of all leaves, from those of the trees' roots by level. Lone leaves are roots."""
    paths = tops[-1]
    for level in range(len(levels) - 1, -1, -1):
        paths = _children(levels[level], paths.select("tree", "at", "subroot", "path", "steps")).unionByName(tops[level])
    return paths


def fold(start: Column, path: Column, steps: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    cut = path.cast("binary")

    def up(state: Column, step: Column) -> Column:
        left, right = step["before"] * _DIGEST, step["after"] * _DIGEST
        joined = F.concat(F.substr(cut, state["at"], left), state["hash"].cast("binary"), F.substr(cut, state["at"] + left, right))
        return F.struct(F.sha2(joined, 256).alias("hash"), (state["at"] + left + right).alias("at"))

    return F.aggregate(steps, F.struct(start.alias("hash"), F.lit(1).alias("at")), up)["hash"]


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", alter: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, steps, altered): a leaf for each row of `docs`, its source's root, the root of all, and its proof.

    Rows of a group ascend by `key`, null first, rows of one key by their digest; groups ascend bytewise, null first. Columns
    that `alter` gives in another form make the digest `altered`, null where the form is the same. Repeated rows are
    leaves each; null and empty values differ; other columns are not read; an empty table gives an empty one. `docs` is a table or a checkpoint.
    """
    alter = dict(alter or {})
    own = leaf([F.col(c) for c in fields])
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    changed = leaf([alter.get(c, F.col(c)) for c in fields]) if alter else F.lit(None).cast("string")
    differs = F.lit(False)
    for column, form in alter.items():
        differs = differs | ~form.eqNullSafe(F.col(column))
    rows = docs.select(
        name.alias("name"), F.col(key).cast("long").alias("doc_id"), own.alias("hash"), F.when(differs, changed).alias("altered"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = _numbered(materialize(rows), "name", "doc_id", "hash", "row")
    sources = materialize(leaves.groupBy("name").agg(F.min("number").alias("tree"), F.count("*").alias("n")))
    n_sources, size, most, total = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size + 16 * n_sources <= NAMES_BYTES:
        named = leaves.join(F.broadcast(sources), "name")
    else:
        named = spread_join(leaves, sources.withColumn("leaves", F.col("n")), "name", total).withColumnRenamed("leaves", "n")
    nodes = named.select("tree", (F.col("number") - F.col("tree")).alias("at"), "hash", "doc_id", "altered", "n")
    levels, roots = _grow(nodes, most)

    ends = [r.select("tree", F.col("hash").alias("subroot"), F.lit(level).alias("level")) for level, r in enumerate(roots)]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    ordered = materialize(_numbered(sources.select("name", "tree"), "name").join(subroots, "tree").select("tree", "number", "subroot", "level"))
    none = F.lit(None)
    tops = ordered.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("number").alias("at"), F.col("subroot").alias("hash"), F.col("tree").alias("doc_id"), none.cast("string").alias("altered"),
        F.lit(n_sources).cast("long").alias("n"),
    )
    top_levels, top_roots = _grow(tops, n_sources)
    last = top_roots[-1].select("tree", "at", "hash", "doc_id", "altered", none.cast("string").alias("subroot"), F.lit("").alias("path"), F.array().cast("array<struct<before:int,after:int>>").alias("steps"))
    empty = [last.where("false")] * len(top_levels)
    found = _descend(top_levels, [*empty, last]).select(F.col("doc_id").alias("tree"), F.col("hash").alias("subroot"), "path", "steps")
    by_source = materialize(found.join(ordered.select("tree", "level"), "tree"))

    heads = []
    for level, end in enumerate(roots):
        here = by_source.where(F.col("level") == level).drop("level")
        known = end.join(here, "tree") if level == 0 else here.select("*", F.lit(0).cast("long").alias("at"), *(F.lit(None).cast(t).alias(c) for c, t in (("hash", "string"), ("doc_id", "long"), ("altered", "string"))))
        heads.append(known.select("tree", "at", "hash", "doc_id", "altered", "subroot", "path", "steps"))
    top = top_roots[-1].select("hash").first()
    return _descend(levels, heads).select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(top[0] if top else None).cast("string").alias("root"), "path", "steps", "altered")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and proof; where five divides crc32(doc_id) the text's A-Z are lower-cased and the proof must fail. Null ids aren't tampered with."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.when(chosen, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    proofs = manifest(docs, alter={"text": lowered})
    folded = proofs.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    def one(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    return "sha256(" + " || ".join(one(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = f"""WITH RECURSIVE
chosen AS (
  SELECT *, CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n, row_number() OVER () AS id
  FROM (SELECT doc_id, coalesce('=' || source, '') AS k, {_sql_leaf("text")} AS leaf, {_sql_leaf("other")} AS altered FROM chosen)
),
nodes AS (
  SELECT k, 0 AS level, pos, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT k, level + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY k, level, pos // {RUN}, n
),
sources AS (SELECT k, hash AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS hash FROM sources
  UNION ALL
  SELECT level + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // {RUN}, n
),
walk AS (
  SELECT id, k, 0 AS level, pos, n, altered AS h, '' AS path FROM leaves
  UNION ALL
  SELECT w.id, w.k, w.level + 1, w.pos // {RUN}, (w.n + {RUN - 1}) // {RUN}, sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.h ELSE s.hash END, '' ORDER BY s.pos)),
    w.path || coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '')
  FROM walk w JOIN nodes s ON s.k = w.k AND s.level = w.level AND s.pos // {RUN} = w.pos // {RUN} WHERE w.n > 1 GROUP BY w.id, w.k, w.level, w.pos, w.n, w.path
),
climb AS (
  SELECT w.id, 0 AS level, s.pos, s.n, w.h, w.path FROM walk w JOIN sources s USING (k) WHERE w.n = 1
  UNION ALL
  SELECT w.id, w.level + 1, w.pos // {RUN}, (w.n + {RUN - 1}) // {RUN}, sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.h ELSE s.hash END, '' ORDER BY s.pos)),
    w.path || coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '')
  FROM climb w JOIN tops s ON s.level = w.level AND s.pos // {RUN} = w.pos // {RUN} WHERE w.n > 1 GROUP BY w.id, w.level, w.pos, w.n, w.path
)
SELECT l.doc_id, l.leaf, s.subroot, t.hash AS root, sha256(c.path) AS proof_sha256, c.h AS folded_root, c.h = t.hash AS verified
FROM leaves l JOIN sources s USING (k) JOIN climb c ON c.id = l.id AND c.n = 1 CROSS JOIN (SELECT hash FROM tops WHERE n = 1) t"""
