"""Each text operator against a brute-force version, and on odd inputs."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SMALL, duck, rows_of
from pyspark.sql import functions as F

from borefield.llm import common, decontamination, packing, preference, quality, secrets, similar, simhash, suffixes, token_counts, tokenizing, topk, toxicity
from borefield.llm.queries import ORACLE_SQL, QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and very long texts, a null id, and columns whose names clash."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "same words here"), (3, "same words here"), (4, long_text), (None, "no id " * 60), (5, "  ünï\x0b")]
    schema = "doc_id long, text string, score string, word int, fp int, salt int, length string, y int, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, "l", 0, None, None, None) for i, t in rows], schema)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL).toPandas()) == rows_of(duck(SMALL).sql(ORACLE_SQL[name]).df())


# 5 and 4


def reference_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    return [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_parts_encode_as_whole_texts_do(name, texts):
    path = public_tokenizers.path(name)
    some = list(texts.values())[:60] + ["", " ", "a\x0bb", "É É é", "<|endoftext|> x<|ENDOFTEXT|>", "it's | a|b", "KKſ", "a  b\n\n c", "中文 가각"]
    if name.endswith(".model"):
        import sentencepiece

        expect = sentencepiece.SentencePieceProcessor(model_file=path).encode(some)
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        expect = [own.encode(t, add_special_tokens=False).ids for t in some]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokenizing.PartEncoder(path).ids(some)] == expect


def test_token_counts(spark, texts, odd):
    got = {r.doc_id: r for r in token_counts.op5_token_counts(spark, SMALL).collect()}
    for (doc_id, text), ids in zip(texts.items(), reference_ids(texts.values()), strict=True):
        assert (got[doc_id].n_bytes, got[doc_id].n_tokens, got[doc_id].over_limit) == (len(text.encode()), len(ids), len(ids) > 2048)
    out = token_counts.count_tokens(odd, WORDS).collect()
    assert len(out) == 7 and sum(r.n_tokens == 0 for r in out) == 2
    assert token_counts.count_tokens(odd.limit(0), WORDS).count() == 0


def check_packing(rows, ids_by_doc, capacity=2048):
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, ids in ids_by_doc.items():
        whole, at = [*ids, 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.piece):
            part = whole[at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    return len(places)


def test_packing(spark, texts, odd):
    rows = packing.op4_best_fit_packing(spark, SMALL).collect()
    used = check_packing(rows, dict(zip(texts, reference_ids(texts.values()), strict=True)))
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1
    out = packing.pack_documents(odd).collect()
    assert check_packing(out, {}) and Counter(r.doc_id for r in out)[3] == 2
    assert packing.pack_documents(odd.limit(0)).count() == 0
    assert packing.pack(odd, WORDS, 256, with_ids=True).where("size(ids) <> length OR length > 256").count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = Counter(rng.integers(1, 65, rng.integers(1, 300)).tolist())
        used, full = Counter(), 0
        for lengths, times in packing.plan_packing(dict(counts), 64):
            assert sum(lengths) <= 64 and times > 0
            full += times
            for x in lengths:
                used[x] += times
        assert used == counts and full <= 1.2 * -(-sum(k * v for k, v in counts.items()) // 64) + 1


# 6


def test_secrets(spark, texts, odd):
    got = {r.doc_id: r for r in secrets.op6_secret_scans(spark, SMALL).collect()}
    patterns = {
        "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
    }
    least = {"assign": 12, "access": 18, "hex": 16}
    for doc_id, text in texts.items():
        spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(patterns.items()) for m in p.finditer(text) if len(m[2] if k == "assign" else m[0]) >= least[k]]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        n = Counter(k for *_, k in spans)
        assert (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == (n["assign"], n["access"], n["hex"])
        assert got[doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(got[doc_id].spans.split(","))
    assert secrets.scan_secrets(odd).count() == 7 and secrets.scan_secrets(odd.limit(0)).count() == 0
    assert secrets.redact_secrets(odd).columns == odd.columns


def test_assignments_are_followed():
    text = 'K = "Zx81+qWe77rTy"\nname = "plain words"\nAuthToken := K\nprivate_key: \'abC9\' + \'dEf8gHi7\'\npassword = "changeme-please"\n'
    found = {text[a:b] for _, a, b, _ in secrets.literals(text)}
    assert found == {"Zx81+qWe77rTy", "abC9' + 'dEf8gHi7'"}
    assert secrets.redact("a token=abcdefghijkl b", secrets.base_spans("a token=abcdefghijkl b")) == "a <SECRET> b"


CODE = """
password = os.environ["DB_PASSWORD_MAIN_1"]
token = get_token_from_Vault9(x)
secret = config.Secret_Token_9
db_pass="Hunter2Hunter2!"
PASSWORD = '''
  Tr1ple-Quoted-9x
'''
if password == "Compared9Not2Set":
def connect(user, password: str = "Typed9Default2x", port=1):
    inner = "Scoped77Value9x"
    self.settings["auth_token"] = inner
outside_token = inner
fine = "Not9Sensitive2At3All"
# api_key = "InA9Comment2x7"
<password>In9Element2x</password>
{"clientSecret": "Json9Secret2x", "note": "a: b"}
export API_TOKEN=Bare9Word2xyz
- private_key: Yaml9Bare2xyz  # note
joined_secret = b"Part9a" "Part2b" + 'xY7'
token: word
"""


def test_the_lexer_knows_what_is_a_literal():
    found = {CODE[a:b]: score for _, a, b, score in secrets.literals(CODE)}
    assert set(found) == {
        "Hunter2Hunter2!", "Tr1ple-Quoted-9x", "Typed9Default2x", "Scoped77Value9x", "InA9Comment2x7", "In9Element2x", "Json9Secret2x",
        "Bare9Word2xyz", "Yaml9Bare2xyz", """Part9a" "Part2b" + 'xY7'""",
    }
    assert all(score >= secrets.THRESHOLD for score in found.values())
    kept = secrets.redact(CODE, [s[:3] for s in secrets.literals(CODE)])
    assert all(line in kept for line in CODE.splitlines()[1:4])
    for text in ('x = """' * 20_000, "a='" * 50_000, "password=" * 50_000, "# " * 100_000, "<a>" * 50_000, " " * 300_000 + "="):
        assert len(secrets.literals(text)) < 50_001  # and soon


# 9 and 10


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, texts, odd):
    got = simhash.op9_simhash(spark, SMALL).collect()
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    roots = closure([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", roots[i]) for i in ids}
    assert simhash.simhash_components(odd).count() == 7 and simhash.simhash_components(odd.limit(0)).count() == 0


def test_no_link_is_lost(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 5), replace=False)) for b in base for _ in range(6)]
    values = sorted({*base, *near})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


@pytest.mark.parametrize("crowd", [4, 256])
def test_dense_balls(spark, monkeypatch, crowd):
    """Split anchors lose no link, and what is emitted of a dense ball grows with its members."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    base = 0x1234_5678_9ABC_DEF0
    values = sorted({base ^ (1 << i) ^ (1 << j) for i in range(60) for j in range(0, i + 1, 3)} | {base ^ (1 << i) ^ (1 << (i + 1)) ^ 7 << 50 for i in range(40)})
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    near = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.links(df).collect()} == near and len(near) > 3 * len(values)
    some = [(r.a, r.b) for r in simhash.representative_links(df).collect()]
    assert closure(some, values) == closure(near, values) and set(some) <= near


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(1000, 1001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 91)}, 1001: 1000}


def slow_spans(texts, size):
    seen = defaultdict(set)
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    for i, w in words.items():
        for p in range(len(w) - size + 1):
            seen[tuple(w[p : p + size])].add(i)
    out = set()
    for i, w in words.items():
        start = end = None
        for p in range(len(w) - size + 1):
            if len(seen[tuple(w[p : p + size])]) > 1:
                if end is None or p > end:
                    if end is not None:
                        out.add((i, start, end))
                    start = p
                end = p + size
        if end is not None:
            out.add((i, start, end))
    return out


def test_repeated_passages(spark, texts, odd):
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffixes.op10_suffix_dedup(spark, SMALL).collect()}
    assert got == slow_spans(texts, 50) and got
    assert suffixes.repeated_spans(odd).count() == 0 and suffixes.repeated_spans(odd.limit(0)).count() == 0


def test_repeated_passages_at_other_lengths(spark):
    rng = np.random.default_rng(2)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.integers(6, 16))) for k in range(6)]
    texts = {i: " ".join(pool[rng.integers(6)] if rng.random() < 0.4 else f"u{rng.integers(4000)}" for _ in range(12)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_spans(df, 8).collect()} == slow_spans(texts, 8)


def spans_of(spark, texts, size, partitions=None):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df = df.repartition(partitions) if partitions else df
    return {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_spans(df, size).collect()}


def test_windows_that_no_neighbour_shows(spark, monkeypatch):
    """A suffix shares one window with a neighbour in one order, one in the other, and one with a suffix that neighbours it in neither."""
    asked = []
    plain = suffixes._windows
    monkeypatch.setattr(suffixes, "_windows", lambda reach: asked.append(reach) or plain(reach))
    rng = np.random.default_rng(5)
    run = [f"r{i}" for i in range(6)]
    texts = {}
    for i in range(120):
        before, after = ([f"{side}{j}{rng.integers(2)}" for j in range(4)] for side in "ab")
        texts[i] = " ".join([f"x{i}", *before, *run, *after, f"y{i}"])
    for partitions in (1, 7):
        assert spans_of(spark, texts, 9, partitions) == slow_spans(texts, 9)
    assert asked


def test_suffixes_that_share_their_run_alone(spark):
    run = " ".join(f"r{i}" for i in range(30))
    texts = {i: " ".join(f"d{i}w{j}" for j in range(40)) + f" {run} " + " ".join(f"d{i}v{j}" for j in range(40)) for i in range(5)}
    assert spans_of(spark, texts, 50) == set()
    assert spans_of(spark, texts, 30) == slow_spans(texts, 30) == {(i, 40, 70) for i in range(5)}


def test_repeats_of_equal_and_long_words(spark):
    long_word = "z" * 5_000
    texts = {
        1: "again " * 130,
        2: "once " + "AGAIN\t" * 60 + "more",
        3: " ".join([long_word, *[f"w{i}" for i in range(49)]]),
        4: " ".join(["front", long_word, *[f"w{i}" for i in range(49)], "back"]),
        5: " ".join([long_word + "z", *[f"w{i}" for i in range(49)]]),
    }
    got = spans_of(spark, texts, 50)
    assert got == slow_spans(texts, 50) and {(1, 0, 130), (2, 1, 61), (3, 0, 50), (4, 1, 51)} <= got and not any(i == 5 for i, *_ in got)


def test_lengths_of_passages_have_bounds(spark, odd):
    for size in (1, 125):
        with pytest.raises(ValueError, match="min_words"):
            suffixes.repeated_spans(odd, size)
    rng = np.random.default_rng(8)
    words = rng.integers(3, size=400)
    texts = {i: " ".join(f"t{w}" for w in words[i * 20 : i * 20 + 180]) for i in range(10)}
    for size in (2, 3, 124):
        assert spans_of(spark, texts, size) == slow_spans(texts, size)


# 2


def slow_contamination(texts, items):
    expect = set()
    own = {i: w for i, t in items.items() if len(w := decontamination.word_hashes(t or ""))}
    for doc_id, text in texts.items():
        w = decontamination.word_hashes(text)
        for i, b in own.items():
            size = min(13, len(b))
            for shift in range(-len(b), len(w)):
                first, past = max(0, -shift), min(len(b), len(w) - shift)
                if past - first >= size and np.convolve(b[first:past] == w[first + shift : past + shift], np.ones(size), "valid").max() >= np.ceil(0.8 * size):
                    expect.add((doc_id, i))
                    break
    return expect


def test_contamination(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.op2_decontamination(spark, SMALL).collect()}
    assert got == slow_contamination(texts, items) and got


def test_substitutions_are_tolerated(spark, odd):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "two words")], "item_id long, text string")
    block = decontamination.seeded_block(decontamination.benchmark_items(bench))
    for a in range(13):
        for b in range(13):
            text = ["x" if i in (a, b) else w for i, w in enumerate(item)]
            assert [r[0] for r in block.overlaps("zz " * 5 + " ".join(text) + " yy")] == [1]
    assert not list(block.overlaps(" ".join(item[:10])))
    assert decontamination.find_contaminated(odd, bench).count() == 0 and decontamination.drop_contaminated(odd, bench).columns == odd.columns
    assert decontamination.find_contaminated(odd, bench.limit(0)).count() == 0


def test_short_items_and_repeated_seeds(spark):
    """Items of two words and of one; equal words throughout; a benchmark that is joined against one that is sent to all tasks."""
    rows = [(1, "two words"), (2, "same " * 400), (3, "single"), (4, "one of six words changed here"), (5, "")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = {1: "here are two words and", 2: "same " * 20_000, 3: "two other words", 4: "a single one", 5: "one of six others changed here", 6: "one of six others altered here"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    one = {(r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, bench).collect()}
    assert one == {(1, 1), (2, 2), (4, 3), (5, 4)}
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, bench, 1).collect()} == one
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench, 1).collect()} == {3, 6}
    block = decontamination.Seeded([(2, "same " * 400)])
    start = time.process_time()
    assert len(list(block.overlaps("same " * 20_000))) == 1 and time.process_time() - start < 5


def test_joined_seeds(spark, odd):
    """Joined by seed, the whole small tables give the rows that the benchmark sent to all gives; copies, equal ids and items given twice count each."""
    docs, bench = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "benchmark")
    hit = {r.doc_id for r in decontamination.find_contaminated(docs, bench).collect()}
    again = docs.where(F.col("doc_id").isin(*list(hit)[:3])).select(docs.columns)
    many = docs.unionByName(again).unionByName(again.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("key", F.lit("clash"))
    twice = bench.unionByName(bench.where("item_id % 7 = 0"))
    rows = lambda words: Counter(tuple(r) for r in decontamination.find_contaminated(many, twice, words).collect())
    joined = rows(1)
    assert joined == rows(10**6) and max(joined.values()) > 1 and None in {r[0] for r in joined}
    kept = lambda words: Counter(tuple(r) for r in decontamination.drop_contaminated(many, twice, words).collect())
    assert kept(1) == kept(10**6)
    assert decontamination.find_contaminated(odd, bench, 1).count() == decontamination.find_contaminated(odd, bench).count()
    assert decontamination.find_contaminated(docs.limit(0), bench, 1).count() == 0 and decontamination.drop_contaminated(odd, bench, 1).columns == odd.columns


def test_hot_keys_are_split(spark, monkeypatch):
    """A third of both sides have one key: it is joined in a grid of tasks, with the same rows as by a plain join."""
    left = spark.range(900).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("x"))
    right = spark.range(90).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("y"))
    monkeypatch.setattr(decontamination, "HOT", 10)
    got = decontamination.split_join(left, right, "k")
    assert Counter(tuple(r) for r in got.select("k", "x", "y").collect()) == Counter(tuple(r) for r in left.join(right, "k").select("k", "x", "y").collect())


# 3 and 8


def test_preferences(spark):
    rows = [(1, True, 0, "user", "hi"), (1, False, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 1, "assistant", "no"), (2, True, 0, None, None), (None, True, 0, "user", "x")]
    out = {r.pair_id: r for r in preference.format_preferences(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    r = out[1]
    assert (r.prompt, r.chosen, r.n_shared) == ("<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", 1)
    start, end = map(int, r.chosen_mask.split(":"))
    assert r.chosen[start:end] == "yes<|end|>"
    assert set(out) == {1, 2} and out[2].rejected == "" and out[2].prompt == ""


def test_preferences_of_conversations(spark):
    """Nearly all pairs share turns, none can forge a mark, and the pieces put together are the conversations."""
    whole = "/root/testdata/sf0.01"
    out = preference.op3_preference_formatting(spark, whole)
    n, shared = out.agg(F.count("*"), F.count_if(F.expr("n_shared > 0 AND prompt <> ''"))).first()
    assert n == spark.read.parquet(f"{whole}/conversations.parquet").select("conv_id").distinct().count() and shared > 0.9 * n
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    rows = [(0, 0, "user", "a <|end|> b"), (0, 1, "assistant", "yes"), (0, 2, "user", "go on"), (0, 3, "assistant", "on"), (0, 4, "user", "bye"), (1, 0, "assistant", "no <\\|"),
            (2, 0, "user", "alone"), (2, 0, "user", "alone"), (4, 0, "assistant", None), (None, 0, "user", "x"), (5, None, "user", "x")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preference._formatted(preference.paired_turns(given), ["block", "pair_id"]).collect()}
    assert set(got) == {0, 1, 2, 4} and [got[i].n_shared for i in (0, 1, 2, 4)] == [3, 0, 1, 0]
    assert got[0].prompt == "<|user|>\na <\\|end|> b<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\ngo on<|end|>\n"
    assert got[0].chosen == "<|assistant|>\non<|end|>\n<|user|>\nbye<|end|>\n" and got[0].rejected == "<|assistant|>\nno <\\\\|<|end|>\n"
    assert [got[0].rejected[slice(*map(int, got[0].rejected_mask.split(":")))]] == ["no <\\\\|<|end|>"] and got[2].chosen == got[4].rejected == ""
    assert preference.format_preferences(spark.createDataFrame([], "pair_id long, chosen boolean, turn long, role string, text string")).count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 32) / 256).tolist()) for i in range(400)] + [(i, [1 / 256] * 32) for i in range(400, 460)]
    rows += [(500, None), (501, [float("nan")] * 32), (502, [None] * 32), (503, [1.0] * 3), (550, [2.0] * 3)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i < 460 or i in (503, 550)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:5]
        assert got[q] == [(i, -s) for s, i in best]


def test_products_beyond_64_bits_are_errors():
    ids, x = np.arange(3), np.full((3, 4), 2.0**30)
    assert topk.best_in_block(x[:1], ids[:1], x, ids, 2) == [(0, 1, 2**62), (0, 2, 2**62)]
    mixed = np.array([[2.0**32, 2.0**32, 1.0], [2.0**32, -(2.0**32), 5.0], [0.0, 3.0, 0.0]])  # each product fits, not each partial sum
    assert topk.best_in_block(mixed[:1], ids[:1], mixed, ids, 2) == [(0, 2, 3 * 2**32), (0, 1, 5)]
    for big in (2.0**32, 2.0**70):
        with pytest.raises(OverflowError):
            topk.best_in_block(np.full((1, 4), big), ids[:1], np.full((3, 4), big), ids, 2)


def test_known_scores_prune_and_lose_nothing():
    rng = np.random.default_rng(9)
    v = np.repeat(rng.integers(-9, 10, (500, 4)), 16, axis=1).astype(float) + rng.integers(0, 2, (500, 64))
    ids, q, q_ids = np.arange(500), v[:20], np.arange(20)
    plain = sorted(topk.best_in_block(q, q_ids, v, ids, 5))
    least = np.array([min(s for i, _, s in plain if i == j) for j in range(20)], float)
    assert sorted(topk.best_in_block(q, q_ids, v, ids, 5, least)) == plain
    a, b = topk.summaries(q, 4), topk.summaries(v, 4)
    assert ((a @ b.T > least[:, None]).mean() < 0.2) and (a @ b.T >= q @ v.T - 1e-6).all()


# 1 and 7


def test_segments_are_those_of_the_definition():
    rng = np.random.default_rng(6)

    def slow(x, low=0):
        best = max(((x[a:b].sum(), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, a, b = best
        return [*slow(x[:a], low), (low + a, low + b), *slow(x[b:], low + b)]

    for _ in range(60):
        x = rng.normal(-0.3, 1.0, rng.integers(0, 14))
        assert [s[:2] for s in toxicity.maximal_segments(x)] == slow(x)


def auc(score, y):
    order = score.rank()
    p = y.sum()
    return (order[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.75), ("op7_quality_classifier", "quality", 0.97)])
def test_held_out_rows_are_told_apart(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    out = out[out.held_out]
    assert out.score.between(0, 1).all() and auc(out.score, out[label]) > least


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for none in (labels, labels.limit(0)):
        assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, none)).where("score BETWEEN 0 AND 1").count() == 7
        assert quality.score_quality(odd, quality.fit_quality(odd, none)).where("score BETWEEN 0 AND 1").count() == 7
    assert toxicity.drop_toxic(odd, toxicity.fit_toxicity(odd, labels)).columns == odd.columns


# The pipeline


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_rows(rows):
    """Of (doc_id, text) rows the least of each component at five-word similarity 0.8, by brute force; ties are equal rows."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [five_words(t) for _, t in rows]
    same = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return Counter(rows[i] for i, root in closure(same, range(len(rows))).items() if i == root)


def test_pipeline(spark, docs, texts):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scans", "packing"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.materialize(stage(spark, kept, SMALL))
        assert kept.columns == docs.columns, name
        rows = Counter((r.doc_id, r.text) for r in before.collect())
        left = Counter((r.doc_id, r.text) for r in kept.collect())
        if name == "near_duplicates":
            assert left == least_rows(rows.elements())
        elif name == "secret_scans":
            assert sorted(i for i, _ in left) == sorted(i for i, _ in rows) and not any(secrets.base_spans(t or "") for _, t in left)
        elif name == "decontamination":
            assert left == Counter({r: n for r, n in rows.items() if not slow_contamination({0: r[1] or ""}, items)})
        else:
            scores = {r.doc_id: r.predicted for r in QUERIES["op1_toxicity"](spark, SMALL).collect()}
            assert left == Counter({r: n for r, n in rows.items() if not scores[r[0]]})
    end = {r.doc_id: r.text for r in kept.collect()}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect(), dict(zip(end, reference_ids(end.values()), strict=True)))


def test_stages_on_odd_rows(spark, odd):
    """Every stage on nulls, empty and very long texts, repeated rows, clashing names, and no rows: which rows stay."""
    import corpus_pipeline

    rows = Counter((r.doc_id, r.text) for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        none = stage(spark, odd.limit(0), SMALL)
        assert none.count() == 0, name
        if name == "packing":
            assert Counter(r.doc_id for r in out.where("piece = 0").collect()) == Counter(i for i, _ in rows.elements())
            continue
        assert out.columns == odd.columns == none.columns, name
        left = Counter((r.doc_id, r.text) for r in out.collect())
        assert left == (least_rows(rows.elements()) if name == "near_duplicates" else rows), name


def test_near_duplicates_by_row(spark):
    """Chains, similarities on either side of 0.8, repeated rows, one id with two texts, rows without id, no words, no rows."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(94)]
    base, fork = " ".join(words), " ".join(words[:80] + [f"x{i}" for i in range(14)])
    near = " ".join(words[:84] + [f"y{i}" for i in range(10)])  # 80 of 100 runs of five words are shared: just 0.8
    far = " ".join(words[:83] + [f"z{i}" for i in range(11)])  # 79 of 101
    given = [(1, base), (1, base), (2, near), (3, far), (None, fork), (None, fork), (4, fork.upper()), (5, "lone text"), (5, base), (6, ""), (None, None), (None, "no id")]
    rows = spark.createDataFrame(given, "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows, SMALL).collect())
    assert left == Counter([(1, base), (3, far), (4, fork.upper()), (5, "lone text"), (6, ""), (None, "no id")]) == least_rows(given)
    assert corpus_pipeline.near_duplicates(spark, rows.limit(0), SMALL).count() == 0


def test_near_copies_of_larger_groups(spark):
    """Groups of edited copies, some of them closer to each other than to the first one: as by brute force."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        base = [f"g{k}w{rng.integers(60)}" for _ in range(260)]
        for _ in range(14):
            own = list(base)
            for at in rng.choice(len(own), rng.integers(0, 9), replace=False):
                own[at] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own)))
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [five_words(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in found} == closure(pairs, range(len(rows))) and len(pairs) > 100


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_hot_keys_join_as_others_do(spark, monkeypatch, how, hot):
    """Whatever the threshold: hot keys, keys without a partner, null keys and empty sides."""
    monkeypatch.setattr(common, "HOT", hot)
    keys = ["a"] * 40 + ["b"] * 3 + ["c", None, "gone"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    partners = spark.createDataFrame([(k, keys.count(k), f"of {k}") for k in "abcz"], "k string, n long, x string")
    got = common.spread_join(rows, partners, "k", len(keys), how)
    assert rows_of(got.toPandas()) == rows_of(rows.join(partners.drop("n"), "k", how).toPandas()) and got.count() == 44
    assert common.spread_join(rows.limit(0), partners, "k", 0, how).count() == 0
    assert common.spread_join(rows, partners.limit(0), "k", len(keys), how).count() == 0


def test_rows_without_id_are_dealt_like_others(spark):
    """A third of the rows has no id and another third one id; the salts of a common length share them evenly."""
    docs = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    pieces = packing.token_pieces(docs, WORDS).withColumn("deal", F.rand(0)).cache()
    buckets = pieces.groupBy(F.floor(F.col("deal") * 30).alias("salt")).count().collect()
    assert len(buckets) == 30 and max(r["count"] for r in buckets) < 2 * 300
    placed = packing.place(pieces).collect()
    assert len(placed) == 9_000 and len({(r.sequence_id, r.offset) for r in placed}) == 9_000


def test_crowds_just_under_the_threshold(spark, monkeypatch):
    """A group of near copies, of which many pairs are less similar than 0.8: the same components as by brute force, whatever counts as crowded."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(160)]
    texts = {i: " ".join(w if rng.random() > rng.choice([0.0, 0.02, 0.05]) else f"x{rng.integers(1 << 30)}" for w in base) for i in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    stable = common.materialize(docs)
    sets = {i: five_words(t) for i, t in texts.items()}
    near = [(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    expect = closure(near, list(sets))
    for crowd in (4, 1000):
        monkeypatch.setattr(similar, "CROWD", crowd)
        got = {r.doc_id: r.component_id for r in similar.similar_components(stable).collect()}
        assert got == expect


def test_anchors_of_equal_nodes_are_one_and_maps_bound_what_sets_share(spark):
    keys = {1: [10, 20, 30, 40], 2: [10, 20, 31, 41], 3: [10, 20, 32, 40], 4: [11, 21, 33, 42]}
    nodes = common.materialize(spark.createDataFrame([(n, -n, k) for n, k in keys.items()], "node long, rank long, keys array<int>"))
    got = {(r.key, r.node): (r.size, r.lead) for r in similar._shared(nodes).collect()}
    assert got == {(10, 1): (3, 3), (10, 2): (3, 3), (10, 3): (3, 3), (40, 1): (2, 3), (40, 3): (2, 3)}

    rng = np.random.default_rng(4)
    pool, pairs = rng.integers(0, 1 << 63, 5000).astype(np.uint64), []
    for n in (3, 40, 150, 900):
        for share in (0.0, 0.5, 0.7, 0.79, 0.8, 0.81, 1.0):
            both = round(2 * n * share / (1 + share))
            x, y = pool[:n], np.concatenate([pool[:both], pool[2000 : 2000 + n - both]])
            pairs.append((n, both, similar.marked(x).tolist(), similar.marked(y).tolist()))
    df = spark.createDataFrame(pairs, "n int, both int, x array<long>, y array<long>")
    may = similar._may_be(("n", "n", "x"), ("n", "n", "y"))
    found = df.select("n", "both", may.alias("may")).collect()
    assert all(r.may for r in found if 10 * r.both >= 8 * (2 * r.n - r.both))
    assert not any(r.may for r in found if r.n in (40, 150) and r.both <= round(2 * r.n * 0.7 / 1.7))


def test_only_members_of_repeated_anchors_are_sent_and_few_pairs_take_their_sets_along(spark, monkeypatch):
    """Anchors of one node don't leave the scan; of ten equal links to two leads only those that connect are compared by whole sets."""
    keys = {n: [1 << 24 | n, 2 << 24 | 7, 3 << 24 | n // 2] + list(range(10_000 * n, 10_000 * n + 200)) for n in range(1, 9)}
    nodes = common.materialize(spark.createDataFrame([(n, -n, k) for n, k in keys.items()], "node long, rank long, keys array<int>"))
    sent = Counter(r.key for r in similar._repeated(nodes).collect())
    assert all(sent[k] == n for k, n in Counter(k for ks in keys.values() for k in ks).items() if n > 1)
    assert sum(n == 1 for n in sent.values()) < 0.2 * 8 * 200

    grams = {n: list(range(100)) for n in range(12)}
    pairs = [(lead, n, n, 5 - lead) for lead in (0, 1) for n in range(2, 12)] + [(0, 1, 1, 1)]
    marks = {n: similar.marked(np.array(g, np.uint64), similar.PAIR_MARKS).tolist() for n, g in grams.items()}
    sets = common.materialize(spark.createDataFrame([(n, g, marks[n]) for n, g in grams.items()], "node long, grams array<long>, wide array<long>"))
    compared, real = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda some, *a: (compared.append(some.count()), real(some, *a))[1])
    roots = similar._led_roots(common.materialize(spark.createDataFrame(pairs, "a long, b long, node long, votes long")), sets)
    assert {r.node: r.root for r in roots.collect()} == {n: 0 for n in range(1, 12)} and compared == [11, 0]


def test_anchors_that_still_have_pairs(spark):
    rows = [(k, n, 3) for k, ns in {1: (1, 2, 3), 2: (1, 2, 4), 3: (4, 5, 6)}.items() for n in ns]
    shared = common.materialize(spark.createDataFrame(rows, "key int, node long, size long"))
    roots = common.materialize(spark.createDataFrame([(2, 1), (3, 1), (5, 4), (6, 4)], "node long, root long"))
    few, all_ = (Counter(map(tuple, f(shared, roots).select("key", "node", "root").collect())) for f in (similar._few_open, similar._open))
    assert few == all_ == Counter([(2, 1, 1), (2, 2, 1), (2, 4, 4)])
