"""The dealt operators against short plain forms of their methods."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("pagemill.llm")
import numpy as np  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagemill.llm import chunks, langid, linear, media, pii, quality, quality_rules, simhash, toxicity  # noqa: E402
from pagemill.llm.common import Ftrl, stored  # noqa: E402
from pagemill.llm.queries import PII_KEY, oracle_sql  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


# --- classifiers ---------------------------------------------------------------------------------


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """FTRL-proximal with one dictionary entry a coordinate; coordinate -1 is the bias."""
    z, n = Counter(), Counter()

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y, weight in rows:
            own = {i: w(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(own[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v * weight
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * own[i]
                n[i] += g * g
    return {i: w(i) for i in z}


def test_ftrl_against_the_plain_form():
    rng = random.Random(2)
    rows = [({**{rng.randrange(16): rng.choice((0.5, 1.0, 2.0)) for _ in range(4)}, -1: 1.0}, rng.randrange(2), rng.choice((1.0, 2.0))) for _ in range(200)]
    want = plain_ftrl(rows, 0.3, 1.0, 3.0, 0.2, 2)
    model = Ftrl(4, 0.3, 1.0, 3.0, 0.2)
    for _ in range(2):
        for x, y, weight in rows:
            model.learn(np.array([16 if i < 0 else i for i in x]), np.array(list(x.values())), y, weight)
    got = model.weights()
    assert all(math.isclose(got[16 if i < 0 else i], v, abs_tol=1e-9) for i, v in want.items()) and 0 in [round(v, 12) for v in want.values()]


@pytest.mark.parametrize("what", [toxicity, quality])
def test_scores_against_the_plain_form(spark, what):
    """Learned and scored by dictionaries over the operator's features: the same scores."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(words if i % 3 else words[:9]) for _ in range(rng.randrange(4, 15))) for i in range(240)} | {900: "", 901: None, 902: "w1 " * 3000}
    labels = {i: int(i % 3 == 0) for i in range(200)}
    spec = linear.Spec(what.grams, bits=14, epochs=2, alpha=0.5, l1=0.2, l2=0.1, shares=what is quality, weights=(2.0, 1.0))
    name = "toxic" if what is toxicity else "quality"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = spark.createDataFrame(list(labels.items()), f"doc_id long, {name} int")
    run = toxicity.score_toxicity if what is toxicity else quality.score_quality
    got = {r.doc_id: r for r in run(docs, rows, spec).collect()}

    from pagemill.llm.common import tokens

    def features(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        ids = Counter(int(h) >> 50 for h in what.grams(*tokens(raw, np.array([0, len(raw)])))[0])
        total = sum(ids.values())
        return {**{i: math.sqrt(k / total) if spec.shares else 1.0 for i, k in ids.items()}, -1: 1.0}

    mod, kept = what.HELD_OUT
    held = {i for i in texts if zlib.crc32(str(i).encode()) % mod == kept}
    turn = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64(F.lit("turn"), "doc_id").alias("t")).collect()}
    learned = sorted((i for i in labels if i not in held), key=turn.get)
    w = plain_ftrl([(features(texts[i]), labels[i], 2.0 if labels[i] else 1.0) for i in learned], 0.5, 1.0, 0.2, 0.1, 2)
    assert {i for i in got if got[i].held_out} == held
    for i, t in texts.items():
        p = 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in features(t).items())))
        assert math.isclose(got[i].score, p, abs_tol=1e-4) and got[i].predicted == int(got[i].score >= 0.7)


def test_quality_held_out_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "text"), (3, "word " * 50_000)], "doc_id long, text string").withColumn("score", F.lit(1))
    none = quality.score_quality(odd, labels.limit(0)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.5}
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_labelled_ids_on_many_rows(spark):
    """The bound on what is learnt from holds for rows, not ids."""
    docs = spark.createDataFrame([(i % 4, f"word{i} text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    spec = linear.Spec(toxicity.grams, bits=12, most_rows=100)
    rows = linear.labelled(docs, labels.withColumnRenamed("toxic", "label"), spec)
    assert 50 < rows.count() < 200 and {r.doc_id for r in rows.collect()} == {0, 1, 2, 3}
    few = linear.Spec(toxicity.grams, bits=12, most_rows=4000)
    assert linear.labelled(docs, labels.withColumnRenamed("toxic", "label"), few).count() == 4000
    assert len(linear.train(docs, labels.withColumnRenamed("toxic", "label"), spec).at) <= 1 << 12


# --- language ------------------------------------------------------------------------------------


def plain_kneser_ney(texts):
    """p(sign | up to three signs before), from interpolated Kneser-Ney over strings."""
    def coded(t):
        return " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "

    lines = [coded(t) for t in texts]
    counts = {4: Counter(x[i : i + 4] for x in lines for i in range(len(x) - 3))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
        counts[n].update(x[:n] for x in lines if len(x) >= n)
    signs = {c for x in lines for c in x if c != " "}

    def p(context, sign, n):
        if n == 0:
            return 1 / (len(signs) + 2)
        c = counts[n]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        before = context[len(context) - n + 1 :] if n > 1 else ""
        follow = {g: v for g, v in c.items() if g[:-1] == before}
        if not follow:
            return p(context, sign, n - 1)
        total = sum(follow.values())
        rest = max(1 - sum(max(v - d, 0) for v in follow.values()) / total, 1e-9)
        return max(c[before + sign] - d, 0) / total + rest * p(context, sign, n - 1)

    return coded, p


def test_kneser_ney_against_the_plain_form():
    samples = {"xx": ["abra cadabra", "barbara bad cab", "crab"], "yy": ["zyx wyz", "xyzzy wwz yx"]}
    model = langid.fit(samples)
    for language, li in (("xx", 0), ("yy", 1)):
        coded, p = plain_kneser_ney(samples[language])
        for text in ("abra zyx", "cab", "wyz bad", "a"):
            line = coded(text)
            want = sum(math.log(p(line[max(0, i - 3) : i], line[i], min(4, i + 1))) for i in range(1, len(line)))
            sums, n, lettered = model.blockwise([text])
            known = set("".join(samples[language]))
            if set(text) - {" "} <= known:  # the other language's letters have a share of the last model too
                assert abs(sums[0, li] - want) < 0.35 * len(line) and n[0] == len(line) - 1 and lettered[0]
    single = langid.fit({"xx": samples["xx"]})
    coded, p = plain_kneser_ney(samples["xx"])
    for text in ("abra", "cadab bar", "crab cab bad"):
        line = coded(text)
        want = sum(math.log(p(line[max(0, i - 3) : i], line[i], min(4, i + 1))) for i in range(1, len(line)))
        assert math.isclose(single.blockwise([text])[0][0, 0], want, rel_tol=1e-4)


def test_language_of_long_texts_and_many_letters(monkeypatch):
    rng = random.Random(1)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    model = langid.fit({"xx": [text("abcde", 50) for _ in range(30)], "yy": [text("vwxyz", 50) for _ in range(30)]})
    long = ["  " + text("abcdexyz", 900) + "  12.3 " + text("abc", 10), None, "", "12", "abc"]
    whole = model.blockwise(long)
    monkeypatch.setattr(langid, "BLOCK", 64)
    cut = model.blockwise(long)
    assert np.allclose(whole[0], cut[0], rtol=1e-9) and (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all()
    # letters beyond those with a number of their own are told apart all the same
    monkeypatch.setattr(langid, "SINGLE", 4)
    monkeypatch.setattr(langid, "LEADS", 5)
    spelled = langid.fit({"xx": [text("abcdefgh", 60) for _ in range(30)], "yy": [text("stuvwxyz", 60) for _ in range(30)]})
    for i, sample in enumerate((text("efgh", 20), text("wxyz", 20))):
        sums, _, _ = spelled.blockwise([sample])
        assert sums[0].argmax() == i
    codes = [tuple(spelled.coded(c).tolist()) for c in "abcdefghstuvwxyz"]
    assert len(set(codes)) == 16 and (spelled.limit < np.inf).all()
    assert all((spelled.coded("abz" * 40 + "x")[a : a + 1] > 0).all() for a in (0, 3))


def test_few_rows_of_a_language_still_reject():
    model = langid.fit({"xx": ["aba bab abba caab"] * 40, "yy": ["zyz yzy zyyz"] * 3})
    assert np.isfinite(model.limit).all() and model.limit[1] == model.limit[0]
    alone = langid.fit({"yy": ["zyz yzy zyyz"] * 3})
    assert math.isclose(alone.limit[0], math.log(langid.n_signs(alone.alphabet)))


# --- substrings ----------------------------------------------------------------------------------


def plain_ends(raw):
    """Chunk ends from the gear hash's definition, byte by byte."""
    gear, ends, h, last = chunks._GEAR.tolist(), [], 0, None
    for i, b in enumerate(raw):
        h = ((h << 2) + gear[b]) & 0xFFFFFFFF
        if h < (1 << 32) // chunks.MEAN:
            if last is None or i + 1 - last >= chunks.NEAR:
                ends.append(i + 1)
            last = i + 1
    ends = [e for e in ends if e < len(raw)] + ([len(raw)] if raw else [])
    out, at = [], 0
    for e in ends:
        while e - at > chunks.LONGEST:
            at += chunks.LONGEST
            out.append(at)
        out.append(e)
        at = e
    return out


def test_substrings_against_the_plain_form(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(70) for _ in range(6)]
    texts = [(i, f"{text(30)} {shared[i % 6]} {text(25)}") for i in range(24)] + [(50, None), (51, ""), (7, "same id, other text " + shared[0]), (3, None), (60, "x" * 9000), (61, "x" * 5000)]
    texts += [(5, texts[5][1]), (None, shared[2] + " " + text(10))]
    key = lambda d: -(1 << 63) if d is None else d
    tid = lambda raw: xxhash.xxh3_64_intdigest(raw) - (1 << 64) * (xxhash.xxh3_64_intdigest(raw) >> 63)
    first, pieces = {}, {}
    for d, t in texts:
        raw = (t or "").encode()
        at = 0
        for e in plain_ends(raw):
            place = (key(d), tid(raw), at)
            first[raw[at:e]] = min(first.get(raw[at:e], place), place)
            pieces.setdefault((key(d), raw), set()).add((at, e))
            at = e
    want = Counter()
    for d, t in texts:
        raw = (t or "").encode()
        spans = sorted((a, e) for a, e in pieces.get((key(d), raw), ()) if first[raw[a:e]] != (key(d), tid(raw), a))
        runs = []
        for a, e in spans:
            if runs and runs[-1][1] == a:
                runs[-1][1] = e
            else:
                runs.append([a, e])
        cut = chunks.passages(np.frombuffer(raw, np.uint8), np.array([a for a, _ in runs], np.int64), np.array([e - a for a, e in runs], np.int64)) if runs else []
        left, at = b"", 0
        for a, e in cut:
            left, at = left + raw[at:a], e
        want[d, None if t is None else (left + raw[at:]).decode(), len(cut)] += 1
    got = Counter((r.doc_id, r.text, r.n_passages) for r in chunks.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == want and sum(n > 0 for _, _, n in got) >= 15


def test_substrings_with_string_ids(spark):
    passage = "the same long passage of words stands in both of these documents and is longer than the least run, " * 2
    rows = [("b", "first words here. " + passage + "more"), ("a", "other words there. " + passage + "end"), (None, "x")]
    got = {r.doc_id: r.n_passages for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["b"] > 0 and got[None] == 0 and set(got) == {"a", "b", None}


# --- personal data -------------------------------------------------------------------------------


def plain_draw(stream, i, n):
    return int(stream[i * 3 % 372 : i * 3 % 372 + 6], 16) % n


def plain_made(part, number):
    """Surrogates of mail addresses, ids and names from the definition."""
    stream = "".join(hashlib.sha256(f"{PII_KEY}|{i}|{number}|{part}".encode()).hexdigest() for i in range(6))
    kind, canon = part.split("|", 1)

    def alike(x, s):
        of = {"d": "0123456789", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz"}
        cls = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else ""
        return "".join(of[cls(c)][plain_draw(s, i, len(of[cls(c)]))] if cls(c) else c for i, c in enumerate(x))

    syllables = lambda n: "".join(pii.SYLLABLES["latin"][plain_draw(stream, i, 16)] for i in range(1, n + 1)).capitalize()
    if kind == "email":
        local, domain = canon.split("@")
        body, top = domain.rsplit(".", 1)
        own = "".join(hashlib.sha256(f"{PII_KEY}|{i}|0|{domain}".encode()).hexdigest() for i in range(6))
        return f"{alike(local, stream)}@{alike(body, own)}.{top}"
    if kind == "family":
        return syllables(6 + number // 2)
    if kind.startswith("given"):
        g = kind[-1], "latin"
        return pii.NAMES[g][plain_draw(stream, 40, 16)] if number == 0 else syllables(3 + number // 2) + pii.ENDS[g]
    return alike(canon, stream)


def test_surrogates_against_the_plain_form(spark):
    """With so many given names that most clash and go on to later numbers."""
    rng = random.Random(8)
    names = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(60)]
    people = [(rng.choice(["Mr", "Frau"]), a, b) for a, b in zip(names[:40], names[20:], strict=True)]
    rows = [(i, f"{t} {a} {b} wrote to {a.lower()}.{i}@mail{i % 3}.example.com about {i:03}-12-3456, and {t} {b} too") for i, (t, a, b) in enumerate(people)]
    parts = set()
    for i, (t, a, b) in enumerate(people):
        parts |= {f"family|{b}", f"given{'m' if t == 'Mr' else 'f'}|{a}", f"email|{a.lower()}.{i}@mail{i % 3}.example.com", f"ssn|{i:03}123456"}
    cls = lambda p: re.sub("^given.", "given", p.split("|", 1)[0])
    own = {(cls(p), p.split("|", 1)[1]) for p in parts}
    number = dict.fromkeys(parts, 0)
    while True:
        made = {p: (cls(p), plain_made(p, n)) for p, n in number.items()}
        times = Counter(made.values())
        least = {}
        for p in sorted(parts, key=lambda p: p.encode()):
            least.setdefault(made[p], p)
        clash = [p for p in parts if made[p] in own or (times[made[p]] > 1 and least[made[p]] != p)]
        if not clash:
            break
        for p in clash:
            number[p] += 1
    assert max(number.values()) >= 1
    of = lambda p: made[p][1]
    want = {}
    for i, (t, a, b) in enumerate(people):
        ssn = of(f"ssn|{i:03}123456")
        want[i] = f"{t} {of('given' + ('m' if t == 'Mr' else 'f') + '|' + a)} {of('family|' + b)} wrote to {of(f'email|{a.lower()}.{i}@mail{i % 3}.example.com')} about {ssn[:3]}-{ssn[3:5]}-{ssn[5:]}, and {t} {of('family|' + b)} too"
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), PII_KEY).collect()}
    assert got == want


def test_pii_of_long_texts(spark):
    text = "plain words without any such thing. " * 30_000
    rows = [(1, text + "mail a.b@example.com" + text), (2, text)]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), PII_KEY).collect()}
    assert got[2] == (text, 0) and got[1][1] == 1 and "a.b@example.com" not in got[1][0] and got[1][0].startswith(text + "mail ") and got[1][0].endswith(text)


# --- quality rules, media, pipeline --------------------------------------------------------------


def test_quality_rules_against_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "share_5", "share_6", "share_8", "share_10", "line_share"]
    want = db.sql(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op3_quality_rules']}) ORDER BY doc_id").fetchall()
    got = quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet")).select(*names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_quality_rules_of_long_and_equal_texts(spark):
    rng = random.Random(3)
    text = " ".join(str(rng.random()) for _ in range(60_000))
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text[:200])], "doc_id long, text string").withColumn("kept", F.lit("x"))
    got = quality_rules.apply_rules(rows).collect()
    assert len(got) == 4 and [r.n_words for r in got if r.doc_id == 1] == [60_000, 60_000] and all(r.kept for r in got if r.doc_id == 1)


def test_media_of_long_texts_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "long " * 200_000), (None, "a"), (None, "a"), (2, None)], "doc_id long, text string")
    got = media.media_documents(rows).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter([(1, 1_000_000), (None, 1), (None, 1), (2, 0)])
    assert media.media_documents(rows.limit(0)).count() == 0


def test_near_duplicate_stage_against_brute_force(spark):
    """The documents that stay are the smallest of each group by pairs of shingle sets, over every pair."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0)]
    for _ in range(len(links) + 1):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {d for d in sets if root[d] == d} and len(got) < len(sets)


def test_pipeline_is_its_stages(spark):
    """run() is the stages one after the other; each keeps, cuts and replaces what its operator says, by itself."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    one = corpus_pipeline.language(spark, docs, SF)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sums, n, lettered = model.blockwise([t for _, t in texts])
    entropy = -sums / np.maximum(n, 1)[:, None]
    limit = model.limit[entropy.argmin(1)] + langid.SHORT / np.sqrt(np.maximum(n, 1))
    assert {r.doc_id for r in one.collect()} == {d for (d, _), ok, low, most in zip(texts, lettered, entropy.min(1), limit, strict=True) if ok and low <= most}
    two = stored(corpus_pipeline.near_duplicates(spark, stored(one, "one"), SF), "two")
    three = stored(corpus_pipeline.substrings(spark, two, SF), "three")
    four = stored(corpus_pipeline.private_data(spark, three, SF), "four")
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in four.collect()}
    mail = re.compile(r"[\w.+-]+@[\w.-]+\.[a-z]{2,}")
    before = {x for r in three.collect() for x in mail.findall(r.text or "")}
    assert before and not before & {x for r in four.collect() for x in mail.findall(r.text or "")}

    from pagemill.llm.tokens import ByteBpe
    from pagemill.llm.queries import tokenizer_path

    bpe, want = ByteBpe(tokenizer_path("byte_bpe_50k.json")), Counter()
    for r in four.collect():
        ids = bpe.id_bytes(r.text or "") + bytes(4)
        at, upto, k = 0, len(ids) // 4 % 2048 or 2048, 0
        while at < len(ids) // 4:
            want[r.doc_id, k, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto])] += 1
            at, upto, k = upto, upto + 2048, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert isinstance(simhash.SIMILARITY, int)
