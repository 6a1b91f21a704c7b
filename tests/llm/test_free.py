"""Language, lines, toxicity, archives, near duplicates, BPE, packing against plain versions."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from llm_plain import naive_join, naive_lines
from sheaf.llm import bpe, components, language, lines, neardup, packing, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "it's they're I'll 'd''s x's't 'start", "  a  b\n\n c \t d  ", "aaaaaaa" * 80, "ab1 2c 33, ...!!'s x 　中文字 😀x", "x" * 3000 + " " * 50 + "y\r\n\r\n", "\x00\x00a\x00", "<|endoftext|>", "\xa0\x85 \u2028z"]


def rows(spark, texts, ids=None, lang="en"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def odd_texts(n=1500, alphabet=" '\n\tstremvld1, .é中 A"):
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]


# --- BPE ------------------------------------------------------------------------------------------------------------

def test_encoding_equals_the_public_libraries():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in odd_texts()]
    own = bpe.Codec.from_ranks(bpe.read_vocabulary(RANKS))
    for t, x in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == public.encode_ordinary(t)
        assert own.decode(x) == t.encode()
        assert [t.encode()[o:] for o in own.offsets(x)[:1]] == [t.encode()] * bool(t)
    other = tokenizers.Tokenizer.from_file(MODEL)
    own = bpe.Codec.from_json(bpe.read_vocabulary(MODEL))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_scan_equals_a_loop():
    f = bpe._STEP[np.random.default_rng(0).integers(0, 3, 5000)]
    state, want = 0, []
    for x in f.tolist():
        state = x >> (2 * state) & 3
        want.append(state)
    assert bpe.scan(f).tolist() == want


def test_bpe_frames(spark):
    df = rows(spark, ODD).withColumn("ids", F.lit("clash"))
    coded = bpe.encode(df, RANKS)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(coded, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    digest = {r.doc_id: r for r in bpe.round_trip(df, RANKS).collect()}
    for r in coded.collect():
        assert digest[r.doc_id].n_tokens == len(r.ids) == len(r.offsets)
        assert digest[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert digest[r.doc_id].decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(df.where("false"), RANKS).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------

def test_packing(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice((3, 40, 400, 3000)))) for _ in range(120)] + ["copy text"] * 20
    out = packing.pack_documents(rows(spark, texts)).collect()
    model = tokenizers.Tokenizer.from_file(MODEL)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        total += len(ids)
        assert [p.piece for p in parts] == list(range(len(parts))) and [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist() and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 1024 for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for slots in by_seq.values():
        slots.sort()
        assert [o for o, _ in slots] == np.cumsum([0, *(n for _, n in slots)])[:-1].tolist() and sum(n for _, n in slots) <= 1024
    assert len(by_seq) <= 1.05 * -(-total // 1024)
    assert packing.pack_documents(rows(spark, [])).count() == 0


def test_plan_equals_one_by_one_best_fit():
    rng = random.Random(7)
    for _ in range(60):
        limit = rng.randint(1, 40)
        lengths = [rng.randint(1, limit) for _ in range(rng.randint(1, 80))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            best = min(fits) if fits else limit
            if fits:
                rooms.remove(best)
            rooms.append(best - n)
        plan = packing.best_fit(collections.Counter(lengths), limit)
        used, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for n, a, b, seq, k, off in plan:
            for r in range(a, b):
                ranks[n].append(r)
                used[seq + (r - a) // k].append((off + (r - a) % k * n, n))
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in collections.Counter(lengths).items()}
        assert len(used) == len(rooms)
        for slots in used.values():
            slots.sort()
            assert [o for o, _ in slots] == np.cumsum([0, *(n for _, n in slots)])[:-1].tolist() and sum(n for _, n in slots) <= limit


# --- language -------------------------------------------------------------------------------------------------------

def naive_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + re.sub(" +", " ", t).strip() + " "
    out = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if g.strip() and " " not in g[1:-1] and g != "  ":
                out[g] += 1
    return collections.Counter({g: k for g, k in out.items() if not (len(g) == 1 and g == " ")})


def test_grams_equal_a_loop():
    text = "Éa bcd abc. Über den x1y bcd"
    codes, counts = language.grams(text)
    want = naive_grams(text)
    assert sorted(counts.tolist()) == sorted(want.values()) and len(codes) == len(want)
    long = "abc défg hij. " * 200_000
    codes2, counts2 = language.grams(long)
    want = naive_grams(long[:1400])
    assert len(codes2) >= len(want) and counts2.sum() > 2 * len("abcdéfghij") * 200_000


def test_language_on_held_out_rows(spark, data):
    df = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    profiles = language.fit(language.training_rows(df))
    assert profiles.names == ["de", "en", "es", "fr"]
    out = language.identify(df.where("crc32(cast(doc_id as string)) % 4 = 2"), profiles)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows(spark, [None, "", "123 ...", "the of and"]), profiles).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] != "und" and 0 <= odd[3][1] <= 1
    kept = language.filter_documents(df.withColumn("score", F.lit("clash")))
    assert kept.columns == [*df.columns, "score"] and kept.count() > 0.99 * df.count()
    assert language.identify(rows(spark, ["text"]), language.fit(df.where("false"))).first().lang_pred == "und"


# --- lines ----------------------------------------------------------------------------------------------------------

def test_lines(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 9))) for _ in range(40)]
    passage = "\n".join(f"shared passage line {i} with a few words more" for i in range(12))
    long = " ".join(f"long{i}" for i in range(60))
    texts = ODD + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(60)] + [f"own start {i}\n{passage}\nown end {i}" for i in range(30)] + [f"head {i}\n{long}\ntail {i}" for i in range(5)]
    df = rows(spark, texts).withColumn("removed", F.lit("clash"))
    want = naive_lines(list(enumerate(texts)))
    for r in lines.dedup(df).collect():
        t = texts[r.row.doc_id]
        assert [(x.first, x.n) for x in r.removed] == want[r.row.doc_id]
        if t is None:
            assert r.text is None
        else:
            gone = {k for a, n in want[r.row.doc_id] for k in range(a, a + n)}
            assert r.text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    out = lines.dedup_documents(df)
    assert out.columns == df.columns and out.count() == len(texts)
    left = {r.doc_id: r for r in out.collect()}
    assert all(r.n_chars == len(r.text) for r in left.values() if r.text is not None)
    shared = [i for i, t in enumerate(texts) if t and passage in t]
    assert sum(passage in left[i].text for i in shared) == 1 and sum(long in (left[i].text or "") for i in left) == 1
    assert lines.dedup_documents(df.where("false")).count() == 0
    twins = lines.dedup_documents(rows(spark, [passage, passage, passage], [5, 5, 6])).orderBy("doc_id").collect()
    assert twins[0].text == twins[1].text == passage != twins[2].text


def whole_line_dedup(texts, long=50):
    """Texts without repeated passages: runs of lines with a word that stand earlier as neighbours, and long lines; walks pairs of lines, without lines.chunks."""
    seen, out = set(), []
    for t in texts:
        all_lines, gone, before = t.split("\n"), set(), None
        for k, x in enumerate(all_lines):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", x))
            if not n:
                continue
            found = [(k, k)] * (n >= long) + ([(before[0], k)] if before and not (n >= long and before[1]) else [])
            for a, b in found:
                key = tuple(all_lines[a : b + 1])
                if key in seen:
                    gone |= set(range(a, b + 1))
                seen.add(key)
            before = (k, n >= long)
        left = [x for k, x in enumerate(all_lines) if k not in gone]
        out.append("" if gone and not "".join(left).strip() else "\n".join(left))
    return out


def test_lines_remove_passages_and_copies_in_full(spark):
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.choice((1, 4, 12, 60))))
    passages = [[line() for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 5, 8, 13, 40)]
    texts = ["\n".join([f"own head {i}", *passages[i % 10], f"own tail {i}"]) for i in range(40)]
    originals = ["\n".join(rng.choice((line(), line(), "", " ")) for _ in range(n)) + "\nan end\n" + line() + "\n\n" for n in (1, 2, 5, 9, 30)]
    texts += originals * 2 + ["a\n\nb", "a\nb\n\nc", "x\na\n\nb\ny", "one line", "one line"]
    df = rows(spark, texts)
    got = {r.doc_id: r.text for r in lines.dedup_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == whole_line_dedup(texts)
    assert all(got[i] == f"own head {i}\nown tail {i}" for i in range(10, 40))
    assert [got[i] for i in range(40, 50)] == originals + [""] * 5
    found = {r.row.doc_id: r for r in lines.dedup(df).select("*", lines.merged("removed").alias("whole")).collect()}
    assert all(found[i].whole == [[1, len(passages[i % 10])]] and found[i].n_removed == len(passages[i % 10]) for i in range(10, 40))


# --- toxicity -------------------------------------------------------------------------------------------------------

def test_grammar_factors():
    s = toxicity.Scorer({"idiot": 4.0, "idiotype$": 0.0}, (-4.0, 1.0, 0.5, 0.5))
    assert s.clause("you idiot") > s.clause("an idiot") > s.clause("not an idiot") > 0
    assert s.clause("he said you idiot") < s.clause("you idiot") and s.clause('" idiot "') < s.clause("idiot")
    assert s.clause("i will kill you now, you") > 0 and s.clause("kill time") < s.clause("you kill")
    assert s.features("the idiotype study")[0] == 0 and s.features("videoidiot")[0] == 0
    assert s.features("fine. you idiot! fine")[2] == pytest.approx(np.log1p(1))
    assert s.score(None) == s.score("") == s.score("plain words") < toxicity.THRESHOLD < s.score("you idiot")


def test_composition_multiplies():
    a, b = toxicity.negation_machine(), toxicity.reported_machine()
    both = a.compose(b)
    rng = random.Random(0)
    x = y = z = 0
    for _ in range(300):
        symbol = rng.randrange(7)
        x, f = a.table[x, symbol]
        y, g = b.table[y, symbol]
        z, h = both.table[z, symbol]
        assert h == pytest.approx(f * g) and z == x * b.states + y


def test_toxicity_on_held_out_rows(spark, data):
    sf = data.replace("0.001", "0.1")
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = [r.predicted for r in out if r.toxic]
    false = [r.predicted for r in out if not r.toxic]
    assert sum(hit) > 0.88 * len(hit) and sum(false) < 0.03 * len(false)
    seed = toxicity.fit(df, labels.where("false"))
    assert seed.lexicon == toxicity.SEED[0]
    assert {r.doc_id: r.score for r in toxicity.score(rows(spark, ODD).select("doc_id", "text"), seed).collect()}[0] < 0.3


# --- archives -------------------------------------------------------------------------------------------------------

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nzzz"
PAGES = [(1, "http://a b\r\nc", "x" * 150), (2, None, "x" * 150), (3, "u", "y"), (4, "u", "y"), (5, "u", None), (None, "u", "x" * 150), (7, "u", FAKE), (8, "v", "é\n\nWARC/1.0\r\n\r\n\r\n" * 9), (8, "v", "twice"), (10, "w", FAKE + "\r\n\r\n" + FAKE)]


def test_archives(spark, tmp_path):
    path = str(tmp_path / "warc")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).coalesce(1)
    warc.write_archives(df, path)
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(PAGES)
    want = collections.Counter((f"<urn:page:{'none' if i is None else i}>", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in PAGES)
    assert collections.Counter((r.record_id, r.payload_bytes, r.payload_digest) for r in out) == want
    assert {r.record_id: r.refers_to for r in out if r.record_type == "revisit"} == {"<urn:page:2>": "<urn:page:1>", "<urn:page:none>": "<urn:page:1>"}
    data = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert len(warc.candidates(data)) > len(PAGES)


def test_pointer_jumping_equals_a_walk():
    rng = random.Random(1)
    for _ in range(50):
        offsets = sorted(rng.sample(range(1, 400), 60)) if rng.random() < 0.1 else [0, *sorted(rng.sample(range(1, 400), 60))]
        successors = [rng.choice([o for o in [*offsets, 500] if o > x] or [500]) for x in offsets]
        walk, at = set(), 0
        while at in offsets:
            walk.add(at)
            at = successors[offsets.index(at)]
        got = warc.reachable(np.array(offsets), np.array(successors))
        assert {o for o, ok in zip(offsets, got, strict=True) if ok} == walk


# --- near duplicates ------------------------------------------------------------------------------------------------

def near_texts(seed, groups=12, hub=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    shared = [word() for _ in range(60)]
    out = ["A b  c", "a B c", "a b c d", "A B C D E", "a b c d e", " "]
    for g in range(groups):
        base = [word() for _ in range(rng.choice((8, 30, 120, 400)))]
        if g % 3 == 0:
            base = shared + base
        for _ in range(rng.randint(1, 6) + hub * (g == 0)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) if rng.random() < 0.8 else " ".join(base))
    return out


@pytest.mark.parametrize(("seed", "hub", "group", "crowd", "cell"), [(1, 0, 64, 2048, 1 << 16), (2, 90, 64, 2048, 1 << 16), (3, 90, 4, 16, 1 << 10)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, hub, group, crowd, cell):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "CELL_SHINGLES", cell)
    texts = ODD + near_texts(seed, hub=hub)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in neardup.join(rows(spark, texts)).collect()}
    assert got == dict(enumerate(naive_join(texts)))


def test_near_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = rows(spark, [text, text, text, None, "", text + " more"], [7, None, 7, 3, 4, 9]).withColumn("h", F.lit("clash"))
    out = neardup.join(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in out if r.doc_id is not None) == [(False, 3, 3), (False, 4, 4), (False, 7, 7), (False, 7, 7), (False, 9, 7)]
    assert [r.component_id for r in out if r.doc_id is None] == [7]
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
    assert neardup.join(df.where("false")).count() == 0
    assert neardup.join(rows(spark, [None, ""])).count() == 2


def test_trie_join_equals_pairs():
    rng = np.random.default_rng(0)
    for own in (True, False):
        make = lambda n: [np.unique(rng.integers(0, 60, rng.integers(5, 40))).astype(np.uint64) for _ in range(n)]
        left = make(30)
        left += [np.setdiff1d(x, x[:1]) for x in left[:15]]
        right = None if own else [np.append(x, 99).astype(np.uint64) for x in left[:20]] + make(10)
        got = set(neardup.trie_join(left, right, 80))
        other = left if own else right
        want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(other) if (not own or j > i) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert {tuple(sorted(p)) if own else p for p in got} == want


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
