"""The operators on small tables: brute force, round trips, and odd rows."""

import hashlib
import math
import random
import re
import zipfile
from collections import Counter
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import bpe, chat, decontaminate, lcp, neardup, pii, ppm, quality, secrets, warczip

PATH = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, spans int"


def odd_rows():
    """Nulls, empty and long texts, repeated rows, repeated ids, and clashing columns."""
    long = "alpha beta gamma delta " * 3000 + "token = abcdefgh1234 mail a.b@c.de " + "x" * 40000
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "four five"), (None, None), (4, long), (4, long), (5, " \n\t"), (6, "é😀 <|endoftext|> <s>")]
    return [(i, t, "en" if n % 3 else None, "s1" if n % 2 else None, None, "clash", 7) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def definition():
    return bpe.read_definition(PATH)


def test_odd_rows_stay_rows(spark, odd, definition):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, None), (None, "")], "item_id long, text string")
    model = pii.train(pii.labelled_table(spark))
    results = {
        "pii": lambda d: pii.find_personal_data(d, model),
        "near": neardup.near_duplicates,
        "secrets": secrets.scan_secrets,
        "ppm": ppm.score,
        "quality": lambda d: quality.judge(d, labels),
        "bpe": lambda d: bpe.encode(d, definition, leaf_chars=900, decoded=True),
        "hits": lambda d: decontaminate.benchmark_hits(d, items),
        "lcp": lcp.edited_likeness,
    }
    ids = Counter(r[0] for r in odd_rows())
    for name, run in results.items():
        assert Counter(r["doc_id"] for r in run(odd).collect()) == ids, name
        assert run(odd.limit(0)).count() == 0, name


def test_filters_keep_columns(spark, odd):
    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    assert quality.keep_good(odd, empty_labels).columns == odd.columns
    assert decontaminate.decontaminate(odd, items).count() == 8
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1
    clean = secrets.redact_secrets(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.where(F.col("text").contains("[secret]")).count() == 2


# -- 1: personal data


def plain_pii(text):
    spans = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            spans.append((2, m.start(), m.end()))
    return spans + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_against_plain_regex():
    rng = random.Random(1)
    parts = ["1", "22", "4111111111111111", "255", ".", "@", "a", "b.c", "-", " ", "+", "+1 (", "é", ")", "x@y.zz"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_crf_adds_and_prunes_exactly(spark):
    model = pii.train(pii.labelled_table(spark))
    texts = ["call (217) 555-0199 now", "jo[at]example.org wrote", "nothing here", "card 4111.1111.1111.1111 ok", ""] * 3
    words = pii.Words(texts)
    count = np.bincount(words.text, minlength=len(texts))
    count = count[count > 0]
    whole = model.viterbi(model.emissions(words.features()), np.cumsum(count) - count, count)
    assert (whole == model.decode(words)).all()
    found = [[pii.KINDS[k] for k, _, _ in added] for _, added in pii.found_spans(model, texts[:4])]
    assert found == [["phone"], ["email"], [], ["card"]]


# -- 2: near-duplicates


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment(monkeypatch):
    rng = random.Random(2)
    for few in (40, 3):
        monkeypatch.setattr(neardup, "FEW", few)
        for _ in range(500):
            a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
            b = [x for x in a if rng.random() < 0.9] + [rng.randint(0, 6) for _ in range(rng.randint(0, 4))]
            most = rng.randint(0, 14)
            got = neardup.edits_within(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), most)
            assert got == min(edit_distance(a, b), most + 1)


def test_groups_with_a_shared_passage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, group = [], {}
    for g in range(30):
        base = [word() for _ in range(90)] + passage
        for _ in range(rng.choice((1, 2, 5))):
            copy = [word() if rng.random() < 0.03 else w for w in base]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {r["doc_id"]: r["class_key"] for r in got}
    for a in group:
        for b in group:
            assert (classes[a] == classes[b]) == (group[a] == group[b])


def with_edits(rng, words, edits, fresh):
    at = set(rng.sample(range(len(words)), edits))
    return [fresh() if i in at else w for i, w in enumerate(words)]


def test_candidates_at_the_least_similarity():
    """Recall of the keys against all pairs, 20 % of the words substituted."""
    rng = random.Random(7)
    fresh = lambda: rng.getrandbits(60)

    def met(a, b):
        x, y = (neardup.keys_of(np.array(w, dtype=np.uint64)) for w in (a, b))
        return bool(len(np.intersect1d(x, y)))

    for n in (5, 9, 10, 20, 34):  # short texts: each pair, wherever the edits are
        for _ in range(200):
            a = [fresh() for _ in range(n)]
            assert met(a, with_edits(rng, a, n // 5, fresh))
    for n in (35, 60, 300):
        bases = [[fresh() for _ in range(n)] for _ in range(300)]
        assert sum(met(a, with_edits(rng, a, n // 5, fresh)) for a in bases) >= 0.98 * 300
        regular = sum(met(a, [fresh() if i % 5 == 4 else w for i, w in enumerate(a)]) for a in bases)
        assert regular >= 0.9 * 300
        assert not any(met(a, b) for a, b in zip(bases, bases[1:]))


def test_one_word_changed_in_short_texts(spark):
    texts = ["a b c d e f g h i", "a b c d x f g h i", "p q r s t", "p q y s t", "k l m n o", "z z z z z"]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kind = {r["doc_id"]: r["class_key"] for r in got}
    assert kind[0] == kind[1] and kind[2] == kind[3] and len(set(kind.values())) == 4


def test_close_copies_in_a_family_of_one_template(spark, monkeypatch):
    """Members too far from each other to be linked, each with one close copy."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        member = [word() for _ in range(40)] + passage
        texts += [member, with_edits(rng, member, 12, word)]
    # With one hash function most texts meet in keys of the passage alone.
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketches=1).collect()
    kind = {r["doc_id"]: r["class_key"] for r in got}
    keys = [set(neardup.keys_of(neardup.word_hashes([t], neardup.ALNUM)[0], sketches=1).tolist()) for _, t in rows]
    together = [(2 * i, 2 * i + 1) for i in range(40) if keys[2 * i] & keys[2 * i + 1]]
    assert len(together) >= 15 and all(kind[a] == kind[b] for a, b in together)
    assert len(set(kind.values())) == len(texts) - len(together)


def test_bounds_leave_every_alike_pair():
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = [rng.randint(0, 400) for _ in range(rng.randint(1, 60))]
        texts += [base, [x for x in base if rng.random() < 0.9], [rng.randint(0, 400) if rng.random() < 0.1 else x for x in base]]
    texts = [np.array(t or [1], dtype=np.uint64) for t in texts]
    bags = [neardup.word_bag(t) for t in texts]
    n = len(texts)
    i, j = neardup.may_be_alike(np.arange(n), np.zeros(n, int), np.array([len(t) for t in texts]), bags)
    alike = {(a, b) for a in range(n) for b in range(a + 1, n) if neardup.alike(texts[a], texts[b])}
    assert len(alike) > 30 and alike <= set(zip(i.tolist(), j.tolist())) and len(i) < n * n / 10


def test_components_of_a_path(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))
    roots = {r["id"]: r["root"] for r in neardup.components(links).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[101] != roots[0]


# -- 3: packages


@pytest.mark.parametrize("zip64", [True, False])
def test_package(zip64):
    data = warczip.package([("archive/a.warc.gz", b"abcdef"), ("indexes/a.warc.gz.cdx", b"p 0 2\nq 2 4")], zip64)
    assert zipfile.ZipFile(BytesIO(data)).read("archive/a.warc.gz") == b"abcdef"
    (at, size, lengths), = warczip.record_ranges(lambda a, n: data[a : a + n], len(data))
    assert data[at : at + size] == b"abcdef" and lengths == [2, 4]


def test_pages_round_trip(spark, tmp_path):
    rows = [(1, "u\r\nv", "same"), (5, None, "same"), (3, "w", "same"), (7, "x", None), (8, "y", ""), (9, "z", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = warczip.read_packages(warczip.write_packages(pages, str(tmp_path))).collect()
    by = {int(r["page"]): r for r in told}
    assert len(told) == 6 and {i: by[i]["refers_to"] for i in by} == {1: "5", 5: None, 3: "5", 7: "8", 8: None, 9: None}
    assert by[1]["payload"] is None and by[1]["payload_bytes"] == 4
    assert bytes(by[9]["payload"]).decode() == "é" * 100_000
    assert by[1]["payload_digest"] == by[5]["payload_digest"] == warczip.base32_sha1(b"same")
    nothing = warczip.write_packages(pages.limit(0), str(tmp_path / "none"))
    assert warczip.read_packages(nothing).count() == 0


# -- 4: chat


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>", "<\\|end|><", "<<SYS>>[\\INST]<</SYS>>", "", None, "<\\\\|text|>"]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(tricky)] + [(2, 0, "user", "only"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.prefix_targets(turns)
    told = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    assert told[1]["turns_text"] == "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert told[1]["loss_text"] == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert told[2]["n_turns"] == told[None]["n_turns"] == 1 and told[2]["loss_text"] == ""
    assert examples.where("conv_id = 1").count() == 4
    assert not [r for r in examples.collect() if r["reply"] and "<|" in r["reply"]]


# -- 5: secrets


def test_secret_patterns_and_verdicts(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = ["token=secret=abcdef token = pass", "secret=token:abcdefgh", "é😀 password: 'hunter2x'", "AKIA" + "A1" * 9, "f" * 30, ""]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secrets.scan_secrets(docs).collect():
        text = texts[r["doc_id"]]
        want = {("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6}
        want |= {("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20}
        want |= {("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24}
        assert {(s["kind"], s["start"], s["end"]) for s in r["spans"]} == want
    copied = spark.createDataFrame([(i, "token = example1234", f"s{i}") for i in range(4)] + [(9, "token = private9876", "s9")], docs.schema)
    verdicts = {r["doc_id"]: r["spans"][0]["verdict"] for r in secrets.scan_secrets(copied).collect()}
    assert verdicts == {0: "example", 1: "example", 2: "example", 3: "example", 9: "live"}


# -- 6: language model


def test_ppm_against_exclusion_by_hand():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40))) for _ in range(5)]
    counts = [{} for _ in range(4)]
    for t in texts:
        data = bytes([ppm.PAD] * 3) + t.encode() + bytes([ppm.END])
        for i in range(3, len(data)):
            for k in range(4):
                counts[k].setdefault(data[i - k : i], Counter())[data[i]] += 1

    def probability(context, symbol):
        p, excluded = 1.0, set()
        for k in (3, 2, 1, 0):
            left = {s: n for s, n in counts[k].get(context[3 - k :], {}).items() if s not in excluded}
            if not left:
                continue
            total, kinds = sum(left.values()), len(left)
            if symbol in left:
                return p * left[symbol] / (total + kinds)
            p, excluded = p * kinds / (total + kinds), excluded | set(left)
        return p / (256 - len(excluded))

    codes, n = np.unique(ppm.contexts(texts)[0], return_counts=True)
    model = ppm.Ppm(codes, n, *ppm._summed(codes & np.uint32(0xFFFF), n))
    asked, _ = ppm.contexts(["abdx é cab"])
    for code, got in zip(asked.tolist(), model.log_probs(asked)):
        raw = code.to_bytes(4, "big")
        assert np.exp(got) == pytest.approx(probability(raw[:3], raw[3]))
    every = (asked[5] & np.uint32(0xFFFFFF00)) | np.arange(256, dtype=np.uint32)
    assert np.exp(model.log_probs(every)).sum() == pytest.approx(1)


def test_ppm_shards_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    parts = {r["doc_id"]: r["score"] for r in ppm.score(docs, shard_rows=8000).collect()}
    assert all(whole[i] == pytest.approx(parts[i]) for i in whole)


# -- 7: quality


def kneser_ney_by_hand(trusted, texts):
    """Log-probabilities by the recursive definition, over dictionaries of words."""
    framed = lambda t: ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
    tri = Counter(tuple(w[i - 2 : i + 1]) for w in map(framed, trusted) for i in range(2, len(w)))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)

    def discount(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(x, 0.1), i + 0.9) for i, x in enumerate(raw)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    def prob(gram):
        counts, d = {1: (uni, d1), 2: (bi, d2), 3: (tri, d3)}[len(gram)]
        following = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        lower = prob(gram[1:]) if len(gram) > 1 else 1 / (len(uni) + 1)
        if not following:
            return lower
        total, lost = sum(following.values()), sum(map(d, following.values()))
        c = counts.get(gram, 0)
        return (c - d(c)) / total + lost / total * lower

    d1, d2, d3 = discount(uni), discount(bi), discount(tri)
    return [sum(math.log(prob(tuple(w[i - 2 : i + 1]))) for i in range(2, len(w))) for w in map(framed, texts)]


@pytest.mark.parametrize("head", [1, 400_000])
def test_kneser_ney_by_definition(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "HEAD", head)  # 1: nearly all n-grams are joined, none applied at once
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice("aa b c d ee F g h".split()) for _ in range(n))
    trusted = [make(rng.randrange(12)) for _ in range(40)]
    texts = [*trusted[:5], *(make(rng.randrange(30)) for _ in range(20)), "", None, "zz a zz b", trusted[0]]
    docs = spark.createDataFrame([(f"d{i}" if i else None, t, "en") for i, t in enumerate(texts)], "doc_id string, text string, lang string")
    found = quality.perplexities(docs.repartition(3), spark.createDataFrame([(t,) for t in trusted], "text string"))
    got = {r.doc_id: r.log_prob for r in found.collect()}
    want = kneser_ney_by_hand(trusted, texts)
    assert found.count() == len(texts)
    for i, w in enumerate(want):
        assert got[f"d{i}" if i else None] == pytest.approx(w, abs=1e-9)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    shares = {r["quality"]: r["kept"] for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.98 and shares[0] < 0.4


def test_each_language_has_its_own_threshold(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("one", "two", "three", "four")) for _ in range(30)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(("ein", "zwei", "drei", "vier")) for _ in range(30)), "de") for i in range(12)]
    rows += [(2000 + i, " ".join(rng.choice(("un", "deux", "trois", "quatre")) for _ in range(30)), "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("lang <> 'fr'").select("doc_id", F.lit(1).alias("quality"))
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    held = {r[0] for r in quality.trusted_split(docs, labels)[1].collect()}
    for first, n, lang in ((0, 300, "en"), (1000, 12, "de")):
        own = [judged[i]["perplexity"] for i in range(first, first + n) if i in held]
        threshold, = {judged[i]["threshold"] for i in range(first, first + n)}
        assert own and threshold in own and threshold >= sorted(own)[int(0.99 * len(own)) - 1], lang
    assert all(judged[2000 + i]["threshold"] is None and judged[2000 + i]["keep"] for i in range(5))


# -- 8: tokens


def test_bpe_trees_equal_the_library(definition):
    coder, rng = bpe.Coder(definition), random.Random(5)
    parts = ["a", "the", "ing", "  ", " ", "\n", "'s", "'", "1", "é", "日本", "😀", "<|endoftext|>", "<|", "!", "_", "\x1c", "　"]
    for _ in range(300):
        some = rng.sample(parts, 4) if rng.random() < 0.5 else parts
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 200)))
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode_batch([text])[0], "<u4").tolist() == want
        size = rng.randint(10, 60)
        for w, near in ((2, 0), (64, 2048)):
            leaves = [coder.stretch(text[i : i + size]) for i in range(0, len(text), size)]
            assert bpe.encode_tree(leaves, w, near).ids.tolist() == want
        assert coder.decode(np.array(want, "<u4").tobytes()) == coder.tokenizer.decode(want, skip_special_tokens=False)


# -- 9: decontamination


def test_search_against_every_window():
    rng = random.Random(6)
    word = lambda: rng.choice("abcd")
    items = [(str(i), " ".join(word() for _ in range(rng.choice((0, 1, 3, 12))))) for i in range(12)]
    searcher = decontaminate.Searcher(items, 6)
    for _ in range(200):
        words = [word() for _ in range(rng.randint(0, 40))]
        hit, found = set(), set()
        for item, text in items:
            own = text.split()
            m = min(6, len(own))
            for i in range(len(own) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == own[i : i + m]:
                        hit |= set(range(j, j + m))
                        found.add(item)
        n, ranges, got = searcher.hits(" ".join(words))
        assert n == len(words) and got == sorted(found)
        assert {p for s, e in ranges for p in range(s, e)} == hit


# -- 10: fingerprints


def test_equal_substrings_share_signatures():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcde fg") for _ in range(n))
    middle = text(3000)
    one, two = text(777) + middle + text(50), text(12) + middle + text(900)
    names = lambda t: {(k, x) for k, n, _, _ in lcp.signatures([t]) for x in n.tolist()}
    inside = names(middle)
    assert len(inside & names(one)) > 0.97 * len(inside) and len(inside & names(two)) > 0.97 * len(inside)


def test_next_and_edited(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in lcp.edited_likeness(docs).collect()}
    for i, after in zip(order, order[1:] + order[:1]):
        cut = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - cut] + texts[after][:cut]
        a, b, c = lcp.sketches([texts[i], edited, texts[after]])
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (lcp.written(a), lcp.written(b))
        assert (r["near_edited"], r["near_next"]) == (lcp.likeness(a, b), lcp.likeness(a, c))
