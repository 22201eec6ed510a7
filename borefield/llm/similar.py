"""Near copies of five-word Jaccard similarity 0.8 or more, found by long SimHash fingerprints and verified exactly.

A pair of similarity 0.8 differs in about 15 % of SimHash bits, far beyond what the anchors of a 64-bit fingerprint
reach. So fingerprints here have `BITS` = 4,096 bits, in which TABLES blocks of WIDTH bits are compared: the covering code of a
block is the trivial one (each value is an anchor, covering radius and threshold 0), which at this distance finds more pairs for
each row sent than codes of radius 1 or 3 do. A pair with a share p of differing bits meets at an anchor of some block
with probability 1 - (1 - (1 - p)^WIDTH)^TABLES. Those that meet are compared by COMPARED bits, and what may be similar by its whole
shingle sets. Fingerprints take runs of three words, which an edit disturbs less; the sets take five.

All bits of a fingerprint cost one pass: a shingle's bits are a row of a Hadamard matrix, given by its hash with a sign,
so a fingerprint is the signs of the transform of the shingles' signed counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, hold, id_text, materialize, small_join, spread_join, tidy
from .simhash import components
from .suffixes import key_filter
from .words import by_text, hashed_words, shingles

SIMILARITY, SHINGLE, FINGERPRINT_SHINGLE = 0.8, 5, 3
BITS, TABLES, WIDTH, COMPARED = 4096, 120, 24, 512
#: Bits of the map of a shingle set that bounds what two sets share: of nodes at crowded anchors, of pairs before their sets are sent.
MARKS, PAIR_MARKS = 512, 2048
#: Differing bits of COMPARED up to which a pair may be similar: four deviations above the mean at SIMILARITY.
_P = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
MAY_DIFFER = math.floor(COMPARED * _P + 4 * math.sqrt(COMPARED * _P * (1 - _P)))
#: An anchor of more nodes is crowded: its nodes are compared in squares of this side, and before that with leads, in TURNS turns of one in SHARES anchors.
CROWD, TURNS, SHARES = 64, 3, 8
#: Bytes of text handled at once, fingerprints made at once.
TEXT_BYTES, _TOGETHER = 1 << 20, 128
_SIDE = math.isqrt(BITS)
_POWERS = (2 ** np.arange(WIDTH)).astype(np.float32)


def _hadamard(n: int) -> np.ndarray:
    m = np.ones((1, 1), np.float32)
    while len(m) < n:
        m = np.block([[m, m], [m, -m]])
    return m


_H = _hadamard(_SIDE)


def long_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(n, BITS) booleans of sets of 64-bit shingle hashes."""
    counts = np.empty((len(sets), BITS), np.float32)
    for i, s in enumerate(sets):
        sign = 1.0 - 2.0 * ((s >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        counts[i] = np.bincount((s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), sign, BITS)
    return (_H @ counts.reshape(-1, _SIDE, _SIDE) @ _H).reshape(-1, BITS) > 0


def anchors(bits: np.ndarray) -> np.ndarray:
    """(n, TABLES) int32: a block's value with the block's number."""
    values = bits[:, : TABLES * WIDTH].reshape(-1, TABLES, WIDTH).astype(np.float32) @ _POWERS
    return values.astype(np.int32) | (np.arange(TABLES, dtype=np.int32) << WIDTH)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    whole = np.concatenate(rows)
    return pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), whole.shape[1]).cast(pa.list_(pa.from_numpy_dtype(whole.dtype)))


@tidy
def _sketches(batches):
    hold("similar")
    for batch in batches:
        for part in by_bytes(batch, limit=TEXT_BYTES):
            nodes, sets, keys, compared = [], [], [], []
            for i, h in enumerate(by_text(*hashed_words(part.column("text"))), 1):
                nodes.append(xxhash.xxh64_intdigest(shingles(h, SHINGLE).tobytes()))
                sets.append(shingles(h, FINGERPRINT_SHINGLE))
                if len(sets) == _TOGETHER or i == part.num_rows:
                    bits = long_fingerprints(sets)
                    keys.append(anchors(bits))
                    compared.append(np.packbits(bits[:, -COMPARED:], axis=1).view(np.int64))
                    sets = []
            ids = [part.column("doc_id"), part.column("rank"), pa.array(np.array(nodes, np.uint64).view(np.int64))]
            yield pa.record_batch([*ids, _lists(keys), _lists(compared)], ["doc_id", "rank", "node", "keys", "bits"])


@tidy
def _grams(batches):
    hold("similar")
    for batch in batches:
        for part in by_bytes(batch, limit=TEXT_BYTES):
            found = [shingles(h, SHINGLE) for h in by_text(*hashed_words(part.column("text")))]
            maps = [[marked(x, size) for x in found] for size in (MARKS, PAIR_MARKS)]
            grams, marks, wide = (pa.array([x.view(np.int64) for x in of], pa.list_(pa.int64())) for of in (found, *maps))
            yield pa.record_batch([part.column("node"), grams, marks, wide], ["node", "grams", "marks", "wide"])


def marked(grams: np.ndarray, size: int = MARKS) -> np.ndarray:
    """A set of hashes as a map of `size` bits, one for each value of their lowest bits that is there."""
    bits = np.zeros(size, bool)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _total(x: str, y: str, bits: int, join: Callable[[Column, Column], Column]) -> Column:
    """The set bits of two maps, joined long by long."""
    return sum((F.bit_count(join(F.get(x, F.lit(i)), F.get(y, F.lit(i)))) for i in range(1, bits // 64)), F.bit_count(join(F.get(x, F.lit(0)), F.get(y, F.lit(0)))))


def _differing(x: str, y: str) -> Column:
    return _total(x, y, COMPARED, lambda a, b: a.bitwiseXOR(b))


def _ends(pairs: DataFrame) -> DataFrame:
    """(node, n): the nodes of pairs (a, b), and how many pairs have it as a."""
    both = pairs.select(F.col("a").alias("node"), F.lit(1).alias("n")).union(pairs.select("b", F.lit(0)))
    return materialize(both.groupBy("node").agg(F.sum("n").alias("n")))


def _sides(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """`pairs` (a, b, ...) with x and y: `name` of either. Only values of nodes that pairs have are sent; one that many pairs have is joined where they lie."""
    held = small_join(values.select("node", F.col(name)), _ends(pairs), "node")
    left = held.where("n > 0").select(F.col("node").alias("a"), F.col(name).alias("x"), "n")
    return spread_join(pairs, left, "a", pairs.count()).join(held.select(F.col("node").alias("b"), F.col(name).alias("y")), "b")


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return materialize(_sides(pairs, nodes, "bits").where(_differing("x", "y") <= MAY_DIFFER).select(pairs.columns))


def _grams_of(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, grams, marks, wide): the shingle sets of some nodes, and their maps of MARKS and PAIR_MARKS bits."""
    wanted = some.select("node").join(nodes.select("node", F.col("first_id").alias("doc_id")), "node")
    texts = small_join(docs, materialize(wanted), "doc_id").dropDuplicates(["node"])
    return materialize(texts.select("node", "text").mapInArrow(_grams, "node long, grams array<long>, marks array<long>, wide array<long>"))


def _bounds(open_: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, own, held, marks) of nodes at crowded anchors: how many shingles they have, how many of them another such node has, too, and their map.

    A shingle that no other of them has is in no intersection, which bounds the similarity of a pair by two numbers of each side.
    """
    grams = _grams_of(open_.select("node").distinct(), nodes, docs)
    single = grams.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    sized = grams.select("node", "marks", F.size("grams").alias("own")).join(alone, "node", "left")
    return materialize(sized.select("node", "own", (F.col("own") - F.coalesce("alone", F.lit(0))).alias("held"), "marks"))


def _may_be(a: tuple[str, str, str], b: tuple[str, str, str], tenths: int = round(10 * SIMILARITY), size: int = MARKS) -> Column:
    """False where the bounds (own, held, marks) of two nodes rule the similarity out; true where one has none.

    A bit that only one map has stands for at least one shingle that the other set lacks.
    """
    (own_a, held_a, x), (own_b, held_b, y) = a, b
    lacks = [F.col(own) - _total(p, q, size, lambda u, v: u.bitwiseAND(F.bitwise_not(v))) for own, p, q in ((own_a, x, y), (own_b, y, x))]
    enough = tenths * (F.col(own_a) + F.col(own_b))
    return F.coalesce(((10 + tenths) * F.least(held_a, held_b) >= enough) & ((10 + tenths) * F.least(*lacks) >= enough), F.lit(True))


def _similar(pairs: DataFrame, grams: DataFrame, tenths: int = round(10 * SIMILARITY)) -> DataFrame:
    """Of (a, b) those whose shingle sets are similar enough, by whole numbers; sets are sent only for pairs that their maps allow."""
    own = grams.select("node", F.struct(F.size("grams").alias("own"), F.col("wide")).alias("map"))
    may = _may_be(("x.own", "x.own", "x.wide"), ("y.own", "y.own", "y.wide"), tenths, PAIR_MARKS)
    left = materialize(_sides(pairs.select("a", "b"), own, "map").where(may).select("a", "b"))
    both = F.size(F.array_intersect("x", "y"))
    return materialize(_sides(left, grams, "grams").where((10 + tenths) * both >= tenths * (F.size("x") + F.size("y"))).select("a", "b"))


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """`rows` with the root of `node`; one that no link has is its own."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(named, node, "left").withColumn(root, F.coalesce(root, node))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Roots once links `more` (a, b) are added; each component before is a star."""
    if not more.head(1):
        return roots
    return materialize(components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)))


def _led_roots(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(node, root) over the similar ones of (a, b, node, votes).

    Each node is first compared with the lead that it shares most anchors with; of the other pairs only those across the components that this makes.
    """
    best = materialize(pairs.groupBy("node").agg(F.max(F.struct("votes", "a", "b")).alias("best")).select("best.a", "best.b"))
    roots = materialize(components(_similar(best, grams)))
    others = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    across = materialize(_rooted(_rooted(others, roots, "a", "of_a"), roots, "b", "of_b").where("of_a <> of_b").select("a", "b"))
    return _joined(roots, _similar(across, grams))


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """`shared` (key, node, size, ...) with root, at anchors of several components that still have pairs to compare."""
    placed = materialize(_rooted(shared, roots))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return materialize(placed.join(mixed, "key", "left_semi"))


def _few_open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """As `_open`, where no anchor is crowded: its rows are compared with each other where they lie together."""
    at = Window.partitionBy("key")
    placed = _rooted(shared, roots).select("*", F.min("root").over(at).alias("low"), F.max("root").over(at).alias("high"))
    return placed.where("low < high").drop("low", "high")


def _bounded(open_: DataFrame, bounds: DataFrame, tenths: int = round(10 * SIMILARITY)) -> DataFrame:
    """`open_` with own, held and marks. A node that can be similar to no other of the crowds leaves crowded anchors, where all are of the crowds, and no others."""
    may = F.coalesce(10 * F.col("held") >= tenths * F.col("own"), F.lit(True))
    return materialize(open_.join(bounds, "node", "left").where((F.col("size") <= CROWD) | may))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _led(open_: DataFrame) -> DataFrame:
    """(a, b): at each anchor one node, chosen by a hash, with those of other components that its bounds allow."""
    first = F.min(F.struct(F.xxhash64("key", "node").alias("hash"), "node", "root", "own", "held", "marks")).alias("lead")
    leads = materialize(open_.groupBy("key").agg(first, F.count("*").alias("n")))
    return spread_join(open_, leads, "key", open_.count()).where((F.col("root") != F.col("lead.root")) & _may_be(("own", "held", "marks"), ("lead.own", "lead.held", "lead.marks"))).withColumn("b", F.col("lead.node")).select(*_ordered("node", "b")).distinct()


def _met(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): at each anchor the plausible pairs across components; a crowded one is cut into squares by its own size.

    Bits and bounds lie with the rows, so that only plausible pairs leave the join.
    """
    parts = F.ceil(F.col("size") / CROWD).cast("int")
    rows = materialize(open_.join(nodes.select("node", "bits"), "node").withColumn("parts", parts))
    a = rows.select("key", F.col("node").alias("a"), F.col("root").alias("of_a"), F.col("bits").alias("x"), F.col("own").alias("own_a"), F.col("held").alias("held_a"), F.col("marks").alias("marks_a"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    b = rows.select("key", F.col("node").alias("b"), F.col("root").alias("of_b"), F.col("bits").alias("y"), F.col("own").alias("own_b"), F.col("held").alias("held_b"), F.col("marks").alias("marks_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    once = (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b"))
    may = _may_be(("own_a", "held_a", "marks_a"), ("own_b", "held_b", "marks_b"))
    return a.join(b, ["key", "part"]).where(once & (_differing("x", "y") <= MAY_DIFFER) & may).select("a", "b").distinct()


#: Keys meet the bits of their filter by a product, in which each bit of a key has a part.
_MIX, _MIX_SHIFT = 0x9E3779B1, 20


def _kept(have: np.ndarray):
    """(key, node, rank) of the keys that a filter lets through."""
    low = (len(have) << 6) - 1

    def run(batches):
        hold("similar")
        for batch in batches:
            keys = batch.column("keys")
            sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
            flat = keys.flatten().to_numpy()
            place = ((flat.astype(np.int64) * _MIX) >> _MIX_SHIFT) & low
            hit = np.flatnonzero((have[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1))
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes)[hit])
            yield pa.record_batch([pa.array(flat[hit]), batch.column("node").take(row), batch.column("rank").take(row)], ["key", "node", "rank"])

    return tidy(run)


def _repeated(nodes: DataFrame) -> DataFrame:
    """(key, node, rank): all members of anchors of several nodes, and few others.

    Keys are counted alone; those of several nodes go to a bitmap of 32 MB at most, so that the other keys, most of all, aren't sent a second time.
    """
    counted = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    several = materialize(counted.where("n > 1").select(F.shiftright(F.col("key").cast("long") * F.lit(_MIX), _MIX_SHIFT).alias("key")))
    kept = nodes.select("node", "rank", "keys").mapInArrow(_kept(key_filter(several)), "key int, node long, rank long")
    return materialize(kept)


def _shared(nodes: DataFrame) -> DataFrame:
    """(key, node, size, lead): anchors of several nodes, each with its node of the least rank; of anchors that have the same nodes one.

    Equal sets of nodes are told by two 64-bit hashes and their size.
    """
    met = _repeated(nodes)
    sets = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"set_{i}") for i in range(2)]
    leads = met.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("lead"), F.count("*").alias("n"), *sets).where("n > 1")
    one = leads.groupBy("n", "set_0", "set_1").agg(F.min(F.struct("key", F.col("lead.node").alias("lead"))).alias("one"))
    one = materialize(one.select("one.*", "n", F.col("n").alias("size")))
    return materialize(spread_join(met.drop("rank"), one, "key", met.count()))


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of `docs`: the least doc_id reachable over links of similarity 0.8 or more.

    Texts of equal shingle sets are one node (texts without words are one, too). At each anchor all nodes are first
    compared with the one of the least rank (a whole number; `docs` may give one, else doc_id, null last); then, where a crowded anchor still holds several
    components, with one chosen by a hash, on other anchors each turn, unless their own shingles rule them out (`_bounds`); last, pairs across components, an anchor's rows spread over tasks. `docs` is read twice and must be stable; rows of one doc_id must have one text.
    """
    docs = id_text(docs, F.coalesce(F.col("rank" if "rank" in docs.columns else "doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"))
    sketches = materialize(docs.mapInArrow(_sketches, "doc_id long, rank long, node long, keys array<int>, bits array<long>"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id").alias("at")
    copies = sketches.groupBy("node").agg(F.min(order).alias("at"), F.min("rank").alias("rank"), F.count("*").alias("copies"))
    first = sketches.select("node", order, "keys", "bits").dropDuplicates(["node", "at"])
    nodes = materialize(copies.join(first, ["node", "at"]).select("node", "rank", "copies", "keys", "bits", F.col("at.doc_id").alias("first_id")))
    shared = _shared(nodes)
    led = shared.where("node <> lead").groupBy("lead", "node").agg(F.count("*").alias("votes"))
    led = materialize(led.select(*_ordered("lead", "node"), "node", "votes"))
    tried = led.select("a", "b")
    plausible = _plausible(led, nodes)
    roots = _led_roots(plausible, _grams_of(_ends(plausible), nodes, docs))
    crowds = _open(shared.drop("lead").where(F.col("size") > max(CROWD, 2)), roots)
    few = shared.drop("lead").where((F.col("size") > 2) & (F.col("size") <= CROWD))
    if crowds.head(1):
        bounds = _bounds(crowds, nodes, docs)
        crowds = _bounded(crowds, bounds)
        for turn in range(TURNS):  # a crowd of near copies grows together here, so that few pairs across components are left
            crowded = crowds.where(F.pmod(F.xxhash64("key"), F.lit(SHARES)) == turn)
            crowded = _open(crowded.drop("root"), roots) if turn else materialize(crowded)
            if not crowded.head(1):
                continue
            led = materialize(_led(crowded).join(tried, ["a", "b"], "left_anti"))
            tried = tried.unionByName(led)
            plausible = _plausible(led, nodes)
            roots = _joined(roots, _similar(plausible, _grams_of(_ends(plausible), nodes, docs)))
        open_ = _open(crowds.drop("root"), roots).unionByName(_bounded(_few_open(few, roots), bounds))
    else:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("own", "int"), ("held", "long"), ("marks", "array<long>"))]
        open_ = materialize(_few_open(few, roots).select("*", *none))
    rest = materialize(_met(open_, nodes).join(tried, ["a", "b"], "left_anti"))
    if rest.head(1):
        roots = _joined(roots, _similar(rest, _grams_of(_ends(rest), nodes, docs)))

    grouped = materialize(nodes.join(roots, "node", "left").select("node", "first_id", "copies", F.coalesce("root", "node").alias("root")))
    least = materialize(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    n, rows = grouped.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    named = spread_join(grouped.select("node", "copies", "root"), least, "root", n)
    named = materialize(named.select("node", "component_id", F.col("copies").alias("n")))
    return spread_join(sketches.select("doc_id", "node"), named, "node", rows).select("doc_id", "component_id")
