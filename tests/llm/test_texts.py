"""Language, toxicity, packing, pieces, licences and lines on awkward and small inputs."""

import itertools
import math
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, licenses, line_dedup, packing, toxicity, viterbi
from quillon.llm.queries import ORACLE_SQL, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_is_learned_and_awkward_texts_are_defined(spark, docs, awkward, nothing):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.train_language_model(docs.where(fold != 2))
    held = langid.identify_language(docs.where(fold == 2), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    got = {r["doc_id"]: r for r in langid.identify_language(awkward, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9, 9_007_199_254_740_993))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[8]["lang_pred"] in model.labels
    assert langid.identify_language(awkward, model).count() == 14
    assert langid.identify_language(nothing, model).count() == 0
    assert langid.train_language_model(nothing.withColumn("lang", F.lit("en"))) is None
    assert {r["lang_pred"] for r in langid.identify_language(awkward, None).collect()} == {"und"}


def test_features_and_ftrl_steps_equal_plain_ones():
    """TF-IDF and FTRL-proximal, one coordinate and one example after the other."""
    texts, langs = ["the cat", "le chat", "a cat sat", "un chat"], ["en", "fr", "en", "fr"]

    def bucket(codes):
        h = codes[0] * 2654435761 & 0xFFFFFFFF
        if len(codes) == 1:
            return h >> 16
        for k in range(1, len(codes)):
            h = ((h ^ (k * 0x5BD1E995 & 0xFFFFFFFF)) * 0x01000193 + codes[k] * 2246822519) & 0xFFFFFFFF
        return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16

    idf = 1.0 + np.arange(langid.BUCKETS) % 5
    plain = []
    for t in texts:
        tf: dict[int, int] = {}
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                b = bucket([ord(c) for c in t[i : i + n]])
                tf[b] = tf.get(b, 0) + 1
        x = {b: (1 + math.log(k)) * idf[b] for b, k in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        plain.append({b: v / norm for b, v in x.items()})
        at, values = langid.features(t, idf)
        assert dict(zip(at.tolist(), values.tolist(), strict=True)) == pytest.approx(plain[-1])
    alpha, beta, l1, l2 = 2.0, 1.0, 0.02, 0.01
    z, n = {}, {}

    def weight(i, y):
        zi = z.get((i, y), 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(n.get((i, y), 0.0))) / alpha + l2)

    for epoch in range(2):
        for e in np.random.default_rng(epoch).permutation(4):
            x = plain[e] | {langid.BUCKETS: 0.1}
            w = {(i, y): weight(i, y) for i in x for y in (0, 1)}
            s = [sum(v * w[i, y] for i, v in x.items()) for y in (0, 1)]
            p = [math.exp(v) / (math.exp(s[0]) + math.exp(s[1])) for v in s]
            for i, v in x.items():
                for y in (0, 1):
                    g = v * (p[y] - (langs[e] == ("en", "fr")[y]))
                    sigma = (math.sqrt(n.get((i, y), 0.0) + g * g) - math.sqrt(n.get((i, y), 0.0))) / alpha
                    z[i, y] = z.get((i, y), 0.0) + g - sigma * w[i, y]
                    n[i, y] = n.get((i, y), 0.0) + g * g
    got, bias = langid._ftrl(pd.DataFrame({"text": texts, "lang": langs}), ("en", "fr"), idf, 2, alpha, beta, l1, l2)
    assert bias.tolist() == pytest.approx([0.1 * weight(langid.BUCKETS, y) for y in (0, 1)])
    want = np.zeros_like(got)
    for i, y in z:
        if i < langid.BUCKETS:
            want[i, y] = weight(i, y)
    assert np.allclose(got, want) and (want == 0).any() and (want != 0).any()


def test_noisy_or_equals_the_plain_product_and_its_fit_is_a_maximum():
    model = toxicity.ToxicityModel({"bad": 4.0, "awfu*": 2.5, "the": 0.1}, -3.0)
    text = "The bad one. Awful and the awful! Clean words here\nthe bad awfully bad."
    clean = 1.0
    for sentence in ({"the", "bad", "one"}, {"awful", "and", "the"}, {"clean", "words", "here"}, {"the", "bad", "awfully"}):
        s = -3.0 + sum({"bad": 4.0, "awful": 2.5, "awfully": 2.5, "the": 0.1}.get(w, 0.0) for w in sentence)
        clean *= 1 - 1 / (1 + math.exp(-s))
    assert toxicity.document_score(text, model) == pytest.approx(1 - clean)
    texts = ["Gruk is here. All fine." if i % 3 == 0 else "All fine. Gruk again." if i % 7 == 0 else "All is fine. So it is." for i in range(200)]
    y = np.array([int("Gruk is" in t) if i % 11 else 1 - int("Gruk is" in t) for i, t in enumerate(texts)])
    w, b = toxicity._fit(texts, y, 5, 3.0, 4000, 0.3, 1e-5)

    def loss(w, b):
        p = np.array([toxicity.document_score(t, toxicity.ToxicityModel(w, b)) for t in texts])
        return -float(np.mean(np.where(y > 0, np.log(p), np.log1p(-p)))) + 1e-5 * sum(w.values())

    best = loss(w, b)
    for step in (-0.05, 0.05):
        assert loss(w, b + step) > best - 1e-6
        assert all(loss(w | {k: max(0.0, v + step)}, b) > best - 1e-6 for k, v in w.items())


def test_fit_holds_a_word_once():
    """A few bytes an occurrence, not an object each."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(3000)])
    texts = [". ".join(" ".join(rng.choice(words, 10)) for _ in range(20)) for _ in range(1000)]
    tracemalloc.start()
    toxicity._fit(texts, (np.arange(1000) % 7 == 0).astype(np.int64), 5, 3.0, 1, 0.3, 1e-5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * 200_000, peak


def test_temperature_lowers_cross_entropy():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) * 4
    logits[np.arange(400), truth] += 2
    assert langid._temperature(logits, truth) > 1.5


def test_toxicity_learns_from_document_labels_and_locates_sentences(spark, awkward, nothing):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    say = lambda: " ".join(rng.choice(words, 8)).capitalize() + "."
    rows = []
    for i in range(400):
        parts, bad = [say() for _ in range(5)], int(i % 4 == 0)
        if bad:
            parts[rng.integers(5)] = f"Some {rng.choice(['gruk', 'blarg'])} here."
        rows.append((i, " ".join(parts), bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df, df.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(df, model).collect()
    assert all(r["predicted"] == r["toxic"] for r in got)
    for r in got:
        assert len(r["toxic_spans"]) == r["toxic"]
        assert all("gruk" in r["text"][s["start"] : s["end"]] or "blarg" in r["text"][s["start"] : s["end"]] for s in r["toxic_spans"])
    odd = {r["doc_id"]: r for r in toxicity.score_toxicity(awkward, model).collect()}
    assert all(odd[i]["score"] == 0 and odd[i]["toxic_spans"] == [] for i in (1, 2))
    assert toxicity.score_toxicity(nothing, model).count() == 0
    none = toxicity.train_toxicity(nothing, df.select("doc_id", "toxic"))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(df, none, locate=False).collect())


def test_packing_round_trip(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    window = 64
    rows = pd.DataFrame([r.asDict() for r in packing.pack(awkward, path, window).collect()], dtype=object)
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    assert set(rows["doc_id"]) == set(texts)
    for doc in texts:
        own = rows[rows["doc_id"].map(lambda d: d == doc)]  # noqa: B023
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1], dtype="<u4")
        copies = 2 if doc == 11 else 1
        assert own["length"].sum() == copies * len(ids) and (own["doc_tokens"] == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].iat[0] == 0 and (s["offset"] + s["length"]).iat[-1] <= window
        assert ((s["offset"] + s["length"]).to_numpy()[:-1] == s["offset"].to_numpy()[1:]).all()
    assert (rows.groupby("sequence_id")["length"].sum() < window).sum() <= 1
    assert packing.pack(nothing, path).count() == 0


def test_packing_many_rows_of_one_id(spark):
    """Repeated rows and null ids: every row is packed, cut pieces have their own checksums, and
    no join multiplies rows."""
    from tokenizers import Tokenizer

    path, text = tokenizer_file("word_bpe_49k.json"), "one two, three " * 180
    other = [" ".join(f"word{i} x{j}" for j in range(150)) for i in range(200)]
    rows = [(7, text)] * 200 + [(None, t) for t in other]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    ids = {t: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for t in {text, *other}}
    assert sum(r["length"] for r in out) == sum(len(ids[t]) for _, t in rows)
    assert sum(r["length"] for r in out if r["doc_id"] == 7) == 200 * len(ids[text])
    crcs = {(s, n, zlib.crc32(np.array(ids[text][s : s + n], dtype="<u4"))) for r in out if r["doc_id"] == 7 for s, n in [(r["start"], r["length"])]}
    assert {(r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == 7} == crcs
    spans = {}
    for r in out:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))
    assert sorted(sum(n for _, n in own) for own in spans.values())[1] == 2048


def test_least_squares_fills_windows():
    histogram = np.zeros(101, dtype=np.int64)
    histogram[[30, 70, 20, 50, 100]] = [40, 25, 10, 12, 3]
    combos = packing.combinations(histogram)
    counts = packing.repeat_counts(histogram, combos)
    used = np.zeros(101, dtype=np.int64)
    for c, n in zip(combos, counts, strict=True):
        assert sum(c) == 100
        for v in c:
            used[v] += n
    assert (used <= histogram).all() and counts.sum() >= 37


def test_pieces_are_the_best_and_round_trip(spark, awkward, nothing):
    model = tokenizer_file("piece_bpe_32k.model")
    encoder = viterbi.ViterbiEncoder(model)
    vocabulary = encoder.vocabulary
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if i in vocabulary.scores}

    def brute(word):
        best = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                if word[s:e] in ids:
                    i = ids[word[s:e]]
                    option = (best[s][0] + vocabulary.scores[i], best[s][1] + [i])
                elif e - s == 1:
                    raw = word[s].encode()
                    option = (best[s][0] + vocabulary.byte_score * len(raw), best[s][1] + [vocabulary.bytes[b] for b in raw])
                else:
                    continue
                if best[e] is None or option[0] > best[e][0]:
                    best[e] = option
        return best[-1][0]

    words = sorted({"▁" + w for w in "the then there thermal 漢字漢 don't supercalifragilistic ünïcödé abcabcabc".split()} | {"▁▁▁x", "▁"})
    for w, coded in zip(words, encoder.add(words), strict=True):
        found = np.frombuffer(coded, dtype="<u4").tolist()
        score = sum(vocabulary.scores.get(i, vocabulary.byte_score) for i in found)
        assert score == pytest.approx(brute(w))
    rows = viterbi.decode_texts(viterbi.encode_texts(awkward, model), model).collect()
    assert all(r["text"] == r["decoded"] for r in rows)
    assert sorted(map(str, viterbi.encode_texts(awkward, model, decoded=True).collect())) == sorted(map(str, rows))
    assert viterbi.encode_texts(nothing, model).count() == 0


def test_licences_match_whole_texts_and_lines(spark, docs, awkward, nothing):
    known, notices = licenses.known_licenses(spark), licenses.known_notices(spark)
    mit = licenses.KNOWN[0][1]
    odd = "  Copyright (c) 1999 A. Body\n" + mit.replace("sublicense", "sub-license").replace("\n", "\n\n").upper()
    df = spark.createDataFrame([(1, odd), (2, mit + " extra"), (3, "x\nReleased under the MIT licence!\ny"), (4, "Released under the MIT License."), (5, mit.replace("Permission", "Allowance")), (6, mit.replace("sublicense", "sublicensed"))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, known, notices).collect()}
    assert (got[4]["license_id"], got[4]["notices"]) == (None, "MIT") and got[5]["license_id"] is None and got[6]["license_id"] is None
    assert got[1]["license_id"] == "MIT" and got[2]["license_id"] is None and got[3]["notices"] == "MIT"
    rows = licenses.scan_licenses(awkward, known, notices).collect()
    assert len(rows) == 14 and {r["notices"] for r in rows if r["doc_id"] == 11} == {"MIT,all-rights-reserved"}
    assert [r["digest"] for r in rows if r["doc_id"] == 1] == [None]
    assert licenses.scan_licenses(nothing, known, notices).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op8_license_scan"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in licenses.scan_licenses(docs, known, notices).collect())


def test_licences_of_a_folder(spark):
    """Every whole licence text at hand is known by its file, whatever its case and line ends."""
    folder = Path("/usr/share/common-licenses")
    files = [f for f in sorted(folder.glob("*")) if f.is_file() and not f.is_symlink()] if folder.exists() else []
    if not files:
        pytest.skip("no licence texts here")
    known = licenses.read_licenses(spark, [str(f) for f in files])
    df = spark.createDataFrame([(i, "  " + f.read_text().upper().replace("\n", "\n\n")) for i, f in enumerate(files)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(df, known, licenses.known_notices(spark)).collect()}
    assert got == {i: f.name for i, f in enumerate(files)}


def brute_lines(rows):
    """Removed (doc, pos) by comparing all lines with each other."""
    places = [(d, p, line) for d, text in sorted(rows, key=lambda r: r[0]) for p, line in enumerate((text or "").split("\n")) if line.strip(" ")]
    kept, root = [], {}
    sets = {}
    for line in dict.fromkeys(x[2] for x in places):
        sets[line] = {line[i : i + 8] for i in range(max(1, len(line) - 7))}
    names = list(sets)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            k = len(sets[a] & sets[b])
            if 10 * k >= 8 * (len(sets[a]) + len(sets[b]) - k):
                parent[find(a)] = find(b)
    gone = set()
    for d, p, line in places:
        r = find(line)
        if r in root and root[r] != (d, p):
            gone.add((d, p))
        root.setdefault(r, (d, p))
        kept.append(r)
    return gone


def test_lines_equal_brute_force(spark, awkward, nothing):
    base = "the quick brown fox jumps over the lazy dog and runs away from the very large bear in the forest number {}"
    rows = [(i, f"{base.format(i % 3)}\nunique line {i * 7919} here {i * i}\n\n{'Common line.' if i % 2 else ''}") for i in range(40)]
    rows += [(100 + r["doc_id"], r["text"]) for r in awkward.where("doc_id is not null").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("removed", F.lit("x"))
    gone = brute_lines(rows)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        old = texts[r["doc_id"]]
        want = None if old is None else "\n".join(x for p, x in enumerate(old.split("\n")) if (r["doc_id"], p) not in gone)
        assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(None, "same\nother a"), (None, "lone b\nsame"), (5, "same\nother c"), (6, "same"), (7, "x first\ny second"), (7, "same\nz third"), (7, "same\nz third")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"] or 99, r["text"], r["n_lines_removed"]) for r in out), key=str)
    assert got == sorted([(99, "other a", 1), (99, "lone b", 1), (5, "same\nother c", 0), (6, "", 1), (7, "x first\ny second", 0), (7, "z third", 1), (7, "z third", 1)], key=str)


def test_lines_compare_settled_lines_too(spark):
    """An original and copies with one edit each, far apart: the copies are alike it, not each other."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        base = "".join(rng.choice(list("abcdefghijklmnopqrstuvw "), 96))
        rows += [base, *(base[:i] + "X" + base[i + 1 :] for i in range(8, 90, 9))]
    rows = [(i, line) for i, line in enumerate(rows)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {(r["doc_id"], 0) for r in got if r["n_lines_removed"]}
    want = brute_lines(rows)
    assert len(want) == 400 and gone <= want and len(gone) >= 0.97 * len(want)


#: Lines of equal, near and different shingles, repeated ones and short ones among them.
LINES = ["", "a", "short", "eight ch", "abcabcabcabcabcabc", "abcabcabcabc", "x" * 50, "x" * 9, "é" * 12, *("one line of words that differs at its end only " + "abcdefghijkl"[:n] for n in (0, 2, 4, 8, 12)), "quite another line that is like no other"]


def test_sets_of_a_pair_are_made_once_in_generated_code(spark):
    texts = spark.createDataFrame([(i, bytes(line, "utf-16-be")) for i, line in enumerate(LINES)], "id long, code binary")
    pairs = spark.createDataFrame([(a, b) for a in range(len(LINES)) for b in range(a)], "src long, dst long")
    found = line_dedup._verified(pairs, texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 2 and "exists(" not in plan
    sets = [{line[i : i + 8] for i in range(max(1, len(line) - 7))} for line in LINES]
    alike = {(a, b) for a in range(len(LINES)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in found.collect()} == alike and alike


def test_buckets_of_two_lines_are_told_by_their_ends(spark):
    """Minima and buckets of lines of every length, against plain ones."""
    base = "the quick brown fox jumps over the lazy dog and 0123456789 runs away from it all"
    lines = [base[:n] for n in range(1, 60)] + ["x" * 40, "\U0001f600 smile " * 9] + [f"{base} {i}" for i in range(5)] + [f"no. {i // 2} {base[i:]}" for i in range(40)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines * 2)], "doc_id long, text string")
    sig = line_dedup.stored(line_dedup.signatures(docs))
    names = {r["id"]: r["line"] for r in docs.select(F.xxhash64("text").alias("id"), F.col("text").alias("line")).distinct().collect()}
    cut = []
    for key, line in names.items():
        code = line.encode("utf-16-be")
        cut += [(key, bytearray(code[2 * i : 2 * i + 16])) for i in range(max(0, len(code) // 2 - 8) + 1)]
    hashes = {}
    for r in spark.createDataFrame(cut, "id long, s binary").select("id", F.hash("s").alias("h")).collect():
        hashes.setdefault(r["id"], []).append(r["h"])
    got = {r["id"]: list(r)[1:] for r in sig.collect()}
    assert got == {key: [min(h ^ m for h in hs) for m in line_dedup._masks()] for key, hs in hashes.items()}
    buckets = {}
    for key, minima in got.items():
        for b, band in enumerate(line_dedup.BANDS):
            buckets.setdefault((b, *(minima[j] for j in band)), set()).add(key)
    couples, large = line_dedup._buckets(sig)
    assert {(r["src"], r["dst"]) for r in couples.collect()} == {(max(s), min(s)) for s in buckets.values() if len(s) == 2}
    found = {}
    for r in large.collect():
        found.setdefault((r["bucket"], r["k"]), set()).add(r["id"])
    assert all(len(s) == k for (_, k), s in found.items())
    assert sorted(sorted(s) for s in found.values()) == sorted(map(sorted, {frozenset(s) for s in buckets.values() if len(s) > 2}))


def test_no_banded_link_is_lost(spark):
    """Families of 16 variants around the threshold: every link of two lines that share a band ends
    in one component, and nine tenths of all links do."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(60):
        base = "".join(rng.choice(list("abcdefghijklmnopqrstuvw "), 200))
        for _ in range(16):
            line = list(base)
            for i in rng.choice(200, 2, replace=False):
                line[i] = "X"
            rows.append("".join(line))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = {r["id"]: r["text"] for r in df.select(F.xxhash64("text").alias("id"), "text").collect()}
    roots = {names[r["id"]]: r["root"] for r in line_dedup.similar_lines(df).collect()}
    minima = {names[r["id"]]: [r[f"m{j}"] for j in range(line_dedup.HASHES)] for r in line_dedup.signatures(df).collect()}
    sets = {x: {x[i : i + 8] for i in range(193)} for x in names.values()}
    links = joined = 0
    for f in range(60):
        for a, b in itertools.combinations(dict.fromkeys(rows[16 * f : 16 * f + 16]), 2):
            k = len(sets[a] & sets[b])
            if 10 * k < 8 * (len(sets[a]) + len(sets[b]) - k):
                continue
            same = roots.get(a, 0) == roots.get(b, 1)
            links, joined = links + 1, joined + same
            if any(all(minima[a][j] == minima[b][j] for j in band) for band in line_dedup.BANDS):
                assert same
    assert links > 150 and joined >= 0.9 * links, (links, joined)


@pytest.mark.parametrize("share", [0.25, 0.5, 0.8])
def test_toxicity_is_learned_at_every_base_rate(share):
    """A third of the rows are copies of one toxic text; clean documents may be long."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    say = lambda: " ".join(rng.choice(words, 8)).capitalize() + "."
    texts, y = [], np.array([i < share * 600 for i in range(600)], dtype=int)
    for i, bad in enumerate(y):
        parts = [say() for _ in range(rng.integers(1, 40))]
        if bad:
            parts[rng.integers(len(parts))] = f"Some {rng.choice(['gruk', 'blarg'])} here."
        texts.append(texts[0] if bad and 0 < i < 200 and share > 1 / 3 else " ".join(parts))
    model = toxicity.ToxicityModel(*toxicity._fit(texts, y, 5, 3.0, 500, 0.3, 1e-5))
    assert [int(toxicity.document_score(t, model) >= 0.5) for t in texts] == list(y)
