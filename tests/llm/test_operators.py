"""Each operator against a plain version of its contract, on a small fixture with every odd case and on the small tables."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillstone.llm.common import dataset_remainder
from quillstone.llm import decontaminate, exact_dedup, langid, ngram_join, personal_data, quality, queries, sentencepieces, toxicity, url_filters, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, token string, fp string, label int"
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from all of the noisy hounds that live near the old red barn by the slow river"
ODD = [None, "", "   ", "a", "Word", "one two three four", "One Two three four", BASE, BASE, BASE.upper(), BASE.replace("lazy", "sleepy"), BASE.replace("quick", "fast"), "x" * 300, "12 + 34", "ñandú straße été \u3000 日本 🙂\n\n\tend", "a@b.c+d@e.f x 10.0.0.256 1.2.3.4.5.6.7.8 +1 (456) 555-2186 4111 1111 1111 1111 +12", "word " * 3000, "  two  blanks ▁ mark ", "<s> <0x0A> </s>"]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), "n", "t", "f", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, ODD)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# 1 --------------------------------------------------------------------------------------------------------------


def plain_tokens(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts.items():
        ids = sp.encode(t or "")
        yield i, (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_sentencepiece_digests(spark, small):
    got = {i: tuple(r)[1:] for i, r in by_id(sentencepieces.encode_digests(small, MODEL)).items()}
    assert got == dict(plain_tokens(dict(enumerate(ODD))))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {i: tuple(r)[1:] for i, r in by_id(queries.op1_sentencepiece(spark, SF)).items()}
    assert got == dict(plain_tokens({r.doc_id: r.text for r in docs.collect()}))


def test_sentencepiece_long_chunks():
    import random

    import sentencepiece

    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.MergeEncoder(MODEL), random.Random(2)
    texts = ["".join(rng.choice("abcdeé日🙂<\n\t0aaaing ") for _ in range(n)) for n in (1, 48, 49, 50, 300, 3000)] + ["".join(rng.choice("abcdefgheinstr") for _ in range(200_000)), "a" * 1_000_000]
    for t, (n, ids, decoded) in zip(texts, coder.encode_batch(texts), strict=True):
        want = sp.encode(t)
        assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), sp.decode(want))


def test_sentencepiece_decode_keeps_columns(spark, small):
    with pytest.raises(ValueError):
        sentencepieces.decode(sentencepieces.encode(small, MODEL), MODEL)


def test_sentencepiece_round_trip(spark, small):
    rows = by_id(sentencepieces.decode(sentencepieces.encode(small, MODEL).drop("decoded"), MODEL))
    assert rows[7].decoded == BASE and rows[0].decoded == "" and rows[0].ids == []
    assert sentencepieces.encode(small.limit(0), MODEL).count() == 0


# 2 --------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_needs_no_bad_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("quality = 1"))
    assert abs(model.prior - labels.where("quality = 1").count() / labels.count()) < 0.1
    got = quality.score(docs, labels, model).join(labels, "doc_id").where(dataset_remainder("doc_id", 5) == 0).toPandas()
    assert ((got.score >= quality.THRESHOLD) == (got.quality == 1)).mean() > 0.95
    # the scores are those of the model on each text alone
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.head(20).itertuples():
        assert r.score == pytest.approx(model.scores(__import__("numpy").array([quality.measures(texts[r.doc_id] or "")]))[0], abs=1e-9)


def test_quality_odd_rows(spark, small):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (8, None, None), (9, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(small, labels).count() == len(ODD)
    assert {r.score for r in quality.score(small, labels.limit(0)).collect()} == {0.5}
    assert quality.score(small.limit(0), labels).count() == 0


# 3 --------------------------------------------------------------------------------------------------------------


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    at = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in at[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_components(spark, small):
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(ngram_join.components(small)).items()}
    assert got == plain_components(dict(enumerate(ODD)))
    assert ngram_join.components(small.limit(0)).count() == 0


def test_jaccard_chains_and_hot_groups(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = [" ".join(f"p{k}" for k in range(40)) + " " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(3, 30))) for i in range(60)]
    for _ in range(150):  # near copies with few to many changes
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    walk = list(base)
    for _ in range(40):  # a chain whose ends differ
        walk[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(walk))
    rng.shuffle(texts)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(ngram_join.components(frame(spark, texts, 1000))).items()}
    assert got == plain_components(dict(enumerate(texts, 1000)))


def test_jaccard_common_passage_repeated_ids_and_clashing_names(spark):
    import random

    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = words(60), words(30)
    texts = [f"{words(rng.randrange(2, 60))} {passage} {words(rng.randrange(2, 60))}" for _ in range(1200)]  # alike in part
    texts += [f"{passage} {words(rng.randrange(1, 12))}" for _ in range(60)]  # alike enough
    texts += [f"{other} {words(k % 9)}".strip() for k in range(40)]
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(ngram_join.components(frame(spark, texts))).items()}
    assert got == plain_components(dict(enumerate(texts)))
    # id 2 has two texts, each like another id's; __gone is a column of the table
    odd = spark.createDataFrame([(1, passage, 0), (2, f"{passage} x", 0), (2, f"{other} y", 0), (3, other, 0), (4, words(20), 0)], "doc_id long, text string, __gone int")
    assert {(r.doc_id, r.component_id) for r in ngram_join.components(odd).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    kept = ngram_join.drop_near(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 4}


def test_jaccard_pairs_that_differ_a_little_too_much_are_few(spark, monkeypatch):
    import random

    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for n in [*[15] * 160, *range(5)]:  # 15 changes each: alike, but not enough; and a group of copies
        w = list(base)
        for k in rng.sample(range(400), n):
            w[k] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows, met = [], ngram_join._met

    def counted(*args):
        out = met(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_met", counted)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(ngram_join.components(frame(spark, texts))).items()}
    assert got == plain_components(dict(enumerate(texts)))
    assert sum(rows) < 20 * len(texts)


def test_jaccard_small_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(queries.op3_ngram_jaccard(spark, SF)).items()}
    assert got == plain_components(docs)


# 4 --------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "short", "x" * 100, "x" * 100, "é" * 50, "y" * 99, "y" * 99, "z" * 5000, "z" * 5000, "z" * 5000]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i}", h, "c") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    at, n = warc.write_archives(pages, str(tmp_path / "archives"))
    rows = by_id(warc.read_archives(spark, at), "page_id")
    assert n == len(rows) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = html.index(h) if len(raw) >= 100 else i
        assert rows[i].payload_digest == hashlib.sha256(raw).hexdigest() and rows[i].payload_bytes == len(raw)
        assert rows[i].record_type == ("response" if first == i else "revisit") and rows[i].refers_to == (None if first == i else first)
        assert rows[i].payload == (raw if first == i else None) or first != i
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_ids_and_attempts(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a b/\u00a0c", "x" * 200), (2, "u", "x" * 200), (2, "u", "y" * 200), (3, None, "y" * 200)], "page_id long, url string, html string")
    at, n = warc.write_archives(pages, str(tmp_path / "archives"))
    (tmp_path / "archives" / warc.ATTEMPTS / "part-000000-00000-lost.warc.zst").write_bytes(b"an attempt that was not committed")
    rows = warc.read_archives(spark, at).collect()
    assert n == len(rows) == 4
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload[:1])) for r in rows if r.page_id != 3) == [(1, "response", None, b"x"), (2, "response", None, b"y"), (2, "revisit", 1, None)]
    assert [r.refers_to for r in rows if r.page_id == 3] == [2] and [r.url for r in rows if r.page_id == 1] == ["http://a%20b/%C2%A0c"]


def test_warc_reader_is_linear():
    import os
    import time

    seconds = []
    for n in (500, 4000):
        w = warc.ArchiveWriter(b"")
        for i in range(n):
            body = os.urandom(2000)
            w.add(warc.record_bytes(i, "u", "response", body, hashlib.sha256(body).hexdigest(), None))
        raw, began = w.take(), time.perf_counter()
        assert sum(1 for _ in warc.read_archive(raw)) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 30 * seconds[0] + 0.5


def test_warc_refuses_damage():
    w = warc.ArchiveWriter(b"")
    w.add(warc.record_bytes(1, "http://a", "response", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    good = w.take()
    assert warc.parse_record(next(warc.read_archive(good)))["payload"] == b"payload"
    for bad in (b"", good[8:], good[:-3], good + b"rest", good[:8] + b"\0\0\0\0" + good[8:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    record = next(warc.read_archive(good))
    for bad in (record[:-1], record.replace(b"payload\r\n\r\n", b"payloae\r\n\r\n"), record.replace(b"WARC-Type", b"X-Type"), b"GET / HTTP/1.1\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# 5 --------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and held.score.between(0, 1).all()


def test_language_odd_rows(spark, small):
    rows = by_id(langid.identify(small))
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {i for i, t in enumerate(ODD) if not any(map(str.isalpha, t or ""))}
    assert {r.lang_pred for r in langid.identify(small.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(small.limit(0)).count() == 0
    kept = langid.with_language(small)
    assert kept.columns == small.columns and kept.count() == sum(any(map(str.isalpha, t or "")) for t in ODD)


def test_language_keeps_letters_without_labels(spark, small):
    kept = langid.with_language(small.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == small.columns and sorted(kept.toPandas().doc_id) == [i for i, t in enumerate(ODD) if any(map(str.isalpha, t or ""))]


def test_language_scores_do_not_depend_on_neighbours(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for t in ("ab", "der die das", "x"):
        alone = model.margins([t])[0]
        for other in ("zzz", "der die", ""):
            assert (model.margins([t, other])[0] == alone).all() and (model.margins([other, t])[1] == alone).all()


def test_language_margins_against_a_plain_version(spark):
    import numpy as np

    from quillstone.llm import textbytes

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    taught = [(t, k) for i, t, k in docs if t and k and zlib.crc32(str(i).encode()) % 5]
    names = sorted({k for _, k in taught})
    counts = np.zeros((len(names), len(langid.GRAMS), 1 << langid.BITS))
    grams = lambda t, n: [b" " + t.lower().encode() + b" "][0]
    bins = lambda t, n: textbytes.gram_bins(np.frombuffer(grams(t, n), "u1"), n, langid.BITS)
    for t, k in taught:
        for i, n in enumerate(langid.GRAMS):
            np.add.at(counts[names.index(k), i], bins(t, n), 1)
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.languages == names
    for _, t, _ in docs[:40]:
        want = np.zeros(model.codes.shape[1])
        for i, n in enumerate(langid.GRAMS):
            p = (counts[:, i] + 0.5) / (counts[:, i] + 0.5).sum(1, keepdims=True)
            w = np.stack([np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0)) for c in model.codes.T], 1)
            want += w[bins(t, n)].mean(0) / len(langid.GRAMS) if len(bins(t, n)) else 0
        assert np.allclose(model.margins([t])[0], want, atol=1e-4)


def test_codewords_differ():
    for n in (1, 2, 3, 4, 7, 20):
        m = langid.codewords(n)
        assert len({tuple(r) for r in m.tolist()}) == n


# 6 --------------------------------------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check_personal(rows, texts):
    for i, t in texts.items():
        want = plain_spans(t)
        n = collections.Counter(s[3] for s in want)
        assert [rows[i][f"n_{k}"] for k in KINDS] == [n[k] for k in KINDS], t
        listed = [f"{s[3]}:{s[0]}:{s[2]}" for s in want]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(rows[i].spans.split(",")) | ({""} if not listed else set())


def test_personal_data(spark, small):
    check_personal(by_id(personal_data.summary(small)), dict(enumerate(ODD)))
    more = ["1" * 20000, "1-" * 9000, "a" * 30000, "1.2.3.4 4111111111111111 a.b@c-d.e", "+1234567890+1234567890 x@y z@w.v", "+12 34 5678901 (2)3 é🙂 q@r.st,"]
    check_personal(by_id(personal_data.summary(frame(spark, more))), dict(enumerate(more)))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_personal(by_id(queries.op6_personal_data(spark, SF)), docs)
    assert personal_data.summary(small.limit(0)).count() == 0


def test_personal_data_in_a_long_log(spark):
    texts = [" ".join(f"10.{i % 256}.{i // 256}.7 x" for i in range(n)) for n in (3, 20_000)]
    check_personal(by_id(personal_data.summary(frame(spark, texts))), dict(enumerate(texts)))


def test_personal_data_takes_out_what_reveals(spark):
    texts = [f"some words {i} here about zebulon@mail.com alias Zorbatron said it" for i in range(4)] + [f"other words {i} here about nothing said it" for i in range(60)]
    rows = by_id(personal_data.summary(frame(spark, texts)))
    assert "gen:" in rows[0].spans and "gen:" not in rows[10].spans
    clean = by_id(personal_data.sanitise(frame(spark, texts)))
    assert "[EMAIL]" in clean[0].sanitised and "Zorbatron" not in clean[0].sanitised and clean[10].sanitised == texts[10]


def revealing_spans(texts):
    """For each text (start, end) of the words that reveal a value of it, a coarser entity or a kind."""
    part = {"email": lambda v: v.split("@")[-1].lower(), "phone": lambda v: re.sub("[^0-9]", "", v)[:5], "card": lambda v: re.sub("[^0-9]", "", v)[:6], "ip": lambda v: ".".join(v.split(".")[:2])}
    base = [plain_spans(t) for t in texts]
    entities = [{e for a, _, z, k in b for e in ((k, t[a:z]), (k, "part", part[k](t[a:z])), k)} for t, b in zip(texts, base)]
    words = [{m[0].lower() for m in re.finditer(r"[^\W\d_]{2,}", t)} for t in texts]
    n_e, n_t = (collections.Counter(x for s in sets for x in s) for sets in (entities, words))
    n_te = collections.Counter((e, t) for es, ts in zip(entities, words) for e in es for t in ts)
    n = len(texts)
    told = {(e, t) for (e, t), k in n_te.items() if n_e[e] < n and k >= 2 and k >= 0.6 * n_e[e] and math.log2(k * n / (n_t[t] * n_e[e])) / math.log2(n / n_e[e]) >= 0.8}
    return [sorted({(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{2,}", t) if any((e, m[0].lower()) in told for e in es) and not any(a < m.end() and m.start() < z for a, _, z, _ in b)}) for t, es, b in zip(texts, entities, base)]


def test_personal_data_takes_out_all_that_reveals(spark):
    filler = "one two three four five six seven eight nine ten eleven twelve "
    texts = [
        "Quorvex " + filler * 20 + "call +1 456 555 2186 now " + filler + "quorvex é🙂 Quorvex end Hapaxes",  # terms far from the value
        filler + "a.b@firm.example badge " + filler, filler + "c.d@firm.example " + filler + "Badge", filler + "e.f@other.example " + filler,  # terms of a domain
        "mailto " + filler + "g@h.io", "mailto " + filler + "i@j.io twice i@j.io", "badge 10.0.0.7 " + filler, *[filler + f"word{i}" for i in range(200)],
        "quorvex and +1 456 555 2186 in a second one",
    ]
    rows = by_id(personal_data.summary(frame(spark, texts)))
    want = revealing_spans(texts)
    for i in range(len(texts)):
        got = sorted((int(a), int(z)) for k, a, z in (x.split(":") for x in rows[i].spans.split(",") if x) if k in ("term", "gen"))
        assert got == want[i], texts[i]
    assert all(want[i] for i in (0, 1, 2, -1)) and not any(want[7:-1])
    clean = by_id(personal_data.sanitise(frame(spark, texts)))
    assert "Hapaxes" in clean[0].sanitised  # in one document only, a word tells nothing
    assert "uorvex" not in clean[0].sanitised and "adge" not in clean[1].sanitised + clean[2].sanitised


# 7 --------------------------------------------------------------------------------------------------------------


def plain_exact(texts):
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in texts.items()}
    groups = collections.defaultdict(list)
    for i, t in low.items():
        groups[t].append(i)
    return {i: (max(groups[t]), len(groups[t]), max(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in low.items()}


def test_exact_groups(spark, small):
    got = {i: tuple(r)[1:] for i, r in by_id(exact_dedup.exact_groups(small)).items()}
    assert got == plain_exact(dict(enumerate(ODD)))
    assert exact_dedup.exact_groups(small.limit(0)).count() == 0
    assert exact_dedup.exact_groups(small.unionAll(small)).where("kept").count() == 2 * sum(x[2] for x in got.values())
    kept = exact_dedup.drop_exact(small)
    assert kept.columns == small.columns and {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if x[2]}


def test_colliding_fingerprints_stay_apart(spark, monkeypatch):
    made = exact_dedup._fingerprints
    texts = frame(spark, ["same", "other", "same", "third"])

    def dull(batches):
        import pyarrow as pa

        for b in made(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1] * b.num_rows, pa.int64()), b.column(2)], b.schema.names)

    monkeypatch.setattr(exact_dedup, "_fingerprints", dull)
    got = by_id(exact_dedup.exact_groups(texts))
    assert [got[i].keep_id for i in range(4)] == [2, 1, 2, 3] and got[0].group_size == 2


def test_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    made = exact_dedup.CountingQuotientFilter
    for n in range(120):
        q, r = int(rng.integers(1, 7)), int(rng.integers(8, 47))
        top = int(rng.integers(1, 2000)) if n % 2 else 2 ** (q + r)  # few quotients with long runs, or all
        keys = [rng.integers(0, min(top, 2 ** (q + r)), int(rng.integers(0, 150)), dtype="u8") for _ in range(2)]
        one, two = (made(q, r, *np.unique(k, return_counts=True)) for k in keys)
        for f, k in ((one, keys[0]), (made.from_bytes(two.to_bytes()), keys[1]), (one.merge(made.from_bytes(two.to_bytes())), np.r_[keys[0], keys[1]])):
            found, counts = f.items()
            assert (found[1:] > found[:-1]).all() and dict(zip(found.tolist(), counts.tolist())) == dict(collections.Counter(k.tolist()))
    fps = rng.integers(0, 2**64, 5000, dtype="u8")
    parts = dict(exact_dedup._filters(np.r_[fps, fps[:100]], 4))
    whole = np.concatenate([f.items()[0] | np.uint64(p << 60) for p, f in parts.items()])
    assert whole.tolist() == np.unique(fps).tolist() and sum(f.items()[1].sum() for f in parts.values()) == 5100


def test_exact_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "A", 1), (None, "a", 2), (3, "a", 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, __gone long")
    rows = exact_dedup.exact_groups(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in rows) == [(0, 3, 3), (0, 3, 3), (3, 3, 3), (4, 5, 2), (5, 5, 2)]
    assert {r.doc_id for r in exact_dedup.drop_exact(df).collect()} == {3, 5}


# 8 --------------------------------------------------------------------------------------------------------------


def plain_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0])) if fits else None


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://b.example.net/de/", "https://example.com/de/1", "http://x.com", "http://x.com?y://z", "ftp://org/fr/", "http://aorg/fr/", "://net/", "http://net", "http://q.net/é\n/x", "http://shop.biz/a", "http://shop.biz/b"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    rows = by_id(url_filters.verdicts(pages, trivial=True), "page_id")
    for i, u in enumerate(URLS):
        host, path, rule = plain_url(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule[0])
        # http://net has no rule, as its path is empty, but is an alias of ://net/
        assert rows[i].verdict == (rule[1] if rule else "block" if u == "http://net" else "allow")
    assert url_filters.verdicts(pages.limit(0)).count() == 0


def test_url_aliases(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [(0, "http://www.p.biz/a?utm_source=x", link("http://q.biz/b")), (1, "http://q.biz/b", None), (2, "http://r.biz/", '<meta http-equiv="refresh" content="0; url=http://q.biz/b">'), (3, "http://k.net/x", link("http://q.biz/b")), (4, "http://s.biz/1", None), (5, "https://s.biz/2/", None), (6, "http://m.biz/", None)]
    redirects = [("http://s.biz/1", "http://z.net/"), ("http://z.net/", "http://s.biz/2"), ("http://s.biz/2", "http://g.org/fr/x"), (None, "http://a/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    more = spark.createDataFrame([*pages, (7, "http://z.net/", None), (8, "http://g.org/fr/x", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame(redirects, "src string, dst string")
    got = {i: (r.verdict, r.decided_by) for i, r in by_id(url_filters.verdicts(df, trivial=True), "page_id").items()}
    assert got[0] == got[1] == got[2] == ("block", "alias") and got[3] == ("block", "rule") and got[6] == ("allow", "default")
    got = {i: (r.verdict, r.decided_by) for i, r in by_id(url_filters.verdicts(more, redirects=edges, trivial=True), "page_id").items()}
    assert got[4] == got[5] == ("allow", "alias") and got[7] == ("block", "rule") and got[8] == ("allow", "rule")


def test_url_targets_that_are_no_pages(spark):
    link = lambda u: f"<link rel=canonical href={u}>"
    pages = [
        (0, "http://s.biz/1", None), (1, "http://t.biz/a/1", link("http://z.net/q")), (2, "http://u.biz/1", link("'http://g.org/fr/x'")), (3, "http://v.biz/1", None),
        (4, "http://w.biz/d/e/1", link("../b.html")), (5, "http://x.biz/d/1", '<META content="0; URL=\'sub/c\'" http-equiv=Refresh>'), (6, "http://y.biz/1", '<link href="//z.net/q?a=1&amp;b=2" rel="nofollow canonical">'),
        (7, "http://k.biz/1", '<base href="http://z.net/m/"><link rel="canonical" href="n">'), (8, "http://l.biz/1", link("mailto:a@z.net")), (9, "http://n.biz/1?u=2", link("/go?u=http://z.net/")), (10, "http://o.biz/1", '<link rel="icon" href="http://z.net/i">'),
    ]
    redirects = [("http://s.biz/1", "http://z.net/"), ("http://v.biz/1", "http://z.net/"), ("http://v.biz/1", "http://g.org/fr/y"), ("http://w.biz/d/b.html", "http://q.net/"), ("http://x.biz/d/sub/c", "http://r.net/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {i: (r.verdict, r.decided_by) for i, r in by_id(url_filters.verdicts(df, redirects=spark.createDataFrame(redirects, "src string, dst string")), "page_id").items()}
    # 0 and 3 share z.net/, of which 3 is allowed by its other target
    assert got == {i: (v, "alias" if d else "default") for i, (v, d) in enumerate([("allow", 1), ("block", 1), ("allow", 1), ("allow", 1), ("block", 1), ("block", 1), ("block", 1), ("block", 1), ("allow", 0), ("allow", 0), ("allow", 0)])}
    assert {i: r.verdict for i, r in by_id(url_filters.verdicts(df, redirects=spark.createDataFrame(redirects[:1], "src string, dst string")), "page_id").items()}[0] == "block"


def test_url_verdicts_against_union_find(spark):
    import random

    rng = random.Random(6)
    hosts = ["a.biz", "b.biz", "x.net", "en.example.net", "g.org", "example.com", "c.biz"]
    paths = ["/", "/en/1", "/de/1", "/fr/1", "/p/2", "/p/2/", "/p/2?utm_source=q", "/p/2#f", "/p/index.html", ""]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?v=' + str(rng.randrange(9))])}"
    for trial, trivial in enumerate((True, False, True, False)):
        pages = [(i, url()) for i in range(60)]
        redirects = [(url(), url()) for _ in range(12)]
        df = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string")
        got = by_id(url_filters.verdicts(df, redirects=spark.createDataFrame(redirects, "src string, dst string"), trivial=trivial), "page_id")
        every = sorted({u for _, u in pages} | {u for r in redirects for u in r})
        forms = {r.u: r.f for r in spark.createDataFrame([(u,) for u in every], "u string").select("u", url_filters.alias_form(F.col("u")).alias("f")).collect()}
        up = {u: u for u in every} | {("form", f): ("form", f) for f in forms.values()}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in [*redirects, *(((u, ("form", f)) for u, f in forms.items()) if trivial else ())]:
            up[top(a)] = top(b)
        told = collections.defaultdict(set)
        for u in every:
            if plain_url(u)[2]:
                told[top(u)].add(plain_url(u)[2][1])
        for i, u in pages:
            rule = plain_url(u)[2]
            assert got[i].verdict == (rule[1] if rule else "allow" if "allow" in told[top(u)] or not told[top(u)] else "block"), (u, got[i])


def test_url_small_tables(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for i, r in by_id(queries.op8_url_filters(spark, SF), "page_id").items():
        host, path, rule = plain_url(urls[i])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])


# 9 --------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.94 and got.score.between(0, 1).all()
    other = got[(got.lang != "en") & (got.toxic == 1)]
    assert other.predicted.mean() > 0.4


def test_toxicity_against_a_plain_version():
    """Windows, lengths, counts and the score of a fixed model, step by step."""
    import zstandard

    ordinary, toxic, weights = b" the quick brown fox and the lazy dog ran over a hill ", b" grubbish snarkel ", [-3.0, 0.1, 1.5, 2.0, 0.5, -0.2, 0.3, 0.7, 0.1, 1.0, 0.4, -0.1, 0.2, 0.6, 0.8, 0.9, 0.05]
    model = toxicity.ToxicityModel(ordinary, toxic, np.array(weights))

    def length(content, window):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=6, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for text in ("The quick, brown GRUBBISH fox snarkel ran over a hill and the lazy dog", "", "one", "snarkel " * 40, "the lazy dog " * 30):
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        gains = []
        raw = " " + " ".join(words) + " "
        blanks = [k for k, c in enumerate(raw) if c == " "]
        marks = sorted({min(bisect.bisect_left(blanks, k * 40), len(blanks) - 2) for k in range(-(-len(raw) // 40))})
        for i, first in enumerate(marks):
            last = marks[i + 1] + 1 if i + 1 < len(marks) else len(blanks) - 1
            window = raw[blanks[first] : blanks[last] + 1].encode()
            gains.append(length(ordinary, window) - length(toxic + ordinary, window))
        reached = [sum(g >= k for g in gains) for k in (1, 2, 3, 4, 6)]
        n = max(len(gains), 1)
        x = [1.0, math.log1p(len(gains)), *(math.sqrt(r / n) for r in reached), *(r / n for r in reached), *(math.log1p(r) for r in reached)]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True))))
        assert model.scores([toxicity.normal(text)])[0] == pytest.approx(want)


def test_toxicity_repeated_rows_and_clashing_names(spark):
    texts = [f"plain words number {i} go here and there" for i in range(40)] + [f"you grubbish snarkel number {i}" for i in range(40)]
    df = frame(spark, texts)
    rows = [(i, 1, int(i >= 40)) for i in range(80)] + [(50, 1, 0), (51, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("score", F.lit(0))
    got = toxicity.score(df.unionAll(df), labels).toPandas()
    assert len(got) == 160 and got.groupby("doc_id").score.nunique().max() == 1
    assert got[got.doc_id >= 40].score.mean() > got[got.doc_id < 40].score.mean() + 0.3
    assert toxicity.train(df, labels, fit_bytes=10) is None


def test_toxicity_odd_rows(spark, small):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (8, None, None), (9, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(small, labels).count() == len(ODD)
    assert {r.score for r in toxicity.score(small, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(small.limit(0), labels).count() == 0
    for t in ODD:
        raw = toxicity.normal(t or "")
        words = [raw[a : a + n] for a, n in toxicity.windows(raw).tolist()]
        assert set(b" ".join(words).split()) == set(raw.split())


def test_toxicity_learns_from_whole_texts(monkeypatch):
    plain = sorted(toxicity.normal(" ".join(f"w{i}x{j}" for j in range(600))) for i in range(900))
    taught = []
    monkeypatch.setattr(toxicity, "_trained", lambda samples, size: taught.append(samples) or b"".join(samples)[-size:])
    toxicity.fit([toxicity.normal(f"grubbish {i} snarkel") for i in range(40)], plain)
    kept = [t for i, t in enumerate(plain) if i % 3]
    assert {w for sample in max(taught, key=len) for w in sample.split()} == {w for t in kept for w in t.split()}


# 10 -------------------------------------------------------------------------------------------------------------


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_matches(spark, small):
    import random

    rng = random.Random(4)
    item = "".join(rng.choice("abcde ") for _ in range(90))
    texts = [None, "", item, f"xx {item.upper()} yy"]
    for n in range(1, 14):
        t = list(item)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["z"], [t[k], "z"]])
        texts.append("pad " * rng.randrange(20) + "".join(t) + " end" * rng.randrange(20))
    bench = spark.createDataFrame([(1, item, "x"), (2, "", "x"), (3, None, "x"), (4, "ab", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        for n, it in ((1, item), (4, "ab")):
            it = decontaminate.normal(it)
            d, k = distance(it, decontaminate.normal(t)), len(it) // decontaminate.CHARS_PER_EDIT
            assert got.get((i, n)) == (d if t and d <= k else None), (i, n)
    assert decontaminate.contamination(small, bench.limit(0)).count() == 0
    assert decontaminate.contamination(small.limit(0), bench).count() == 0
    kept = decontaminate.drop_contaminated(small, bench.where("item_id = 1"))
    assert kept.columns == small.columns and kept.count() == len(ODD)


def test_items_with_repeated_ids_and_short_ones(spark):
    texts = ["here the first text of the item", "and the second text of it is", "bat", "quiet", "zzz"]
    bench = spark.createDataFrame([(1, "the first text of the item"), (1, "the second text of it is"), (1, "the second text of it is"), (2, "q"), (3, "bet"), (None, "zzz")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.distance) for r in decontaminate.contamination(frame(spark, texts), bench).collect())
    assert got == [(0, 1, 0), (1, 1, 0), (3, 2, 0), (4, 0, 0)]
    odd = frame(spark, texts).withColumn("__leak", F.lit(1))
    assert {r.doc_id for r in decontaminate.drop_contaminated(odd, bench).collect()} == {2} and decontaminate.drop_contaminated(odd, bench).columns == odd.columns


def test_items_in_several_blocks(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect())) == whole
    for r in whole:
        assert r[2] <= 40


# all ------------------------------------------------------------------------------------------------------------


def test_same_rows_as_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql).fetchdf()
        got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
        order = list(want.columns[:1])
        pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


def test_split_is_crc32(spark):
    rows = spark.range(0, 100_000, 997).select(F.col("id").alias("doc_id"))
    for m in (4, 5):
        got = rows.select("doc_id", dataset_remainder("doc_id", m).alias("r")).collect()
        assert all(x.r == zlib.crc32(str(x.doc_id).encode()) % m for x in got)


def plain_leaks(text, items):
    """Whether a test item is in the text within its edits, by plain dynamic programming where an exact look does not tell."""
    t = decontaminate.normal(text)
    for it in items:
        k = len(it) // decontaminate.CHARS_PER_EDIT
        if it in t:
            return True
        # an occurrence with k edits has one of k + 1 pieces intact; only then the distance is worked out
        if k and any(it[len(it) * i // (k + 1) : len(it) * (i + 1) // (k + 1)] in t for i in range(k + 1)) and distance(it, t) <= k:
            return True
    return False


def plain_pipeline(docs, items):
    left = {i: t for i, t in docs.items() if any(map(str.isalpha, t or ""))}
    keep = plain_exact(left)
    left = {i: t for i, t in left.items() if keep[i][2]}
    group = plain_components(left)
    left = {i: t for i, t in left.items() if group[i][1] == i}
    left = {i: t for i, t in left.items() if not plain_leaks(t, items)}
    return dict(plain_tokens(left))


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i: tuple(r)[1:] for i, r in by_id(corpus_pipeline.run(spark, SF)).items()} == plain_pipeline(docs, items)


def test_pipeline_odd_tables(spark, tmp_path, small):
    import corpus_pipeline

    item = "some words that are asked for in a test of the kind that must not leak"
    texts = [*ODD, f"before {item} after", f"before {item.replace('asked', 'askt')} after", "word " * 40_000, "x" * 100_000]
    odd = frame(spark, texts).withColumns({"__gone": F.lit(1), "__leak": F.lit(2), "lang": F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang"))})
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    sf = folder(tmp_path, documents=odd, benchmark=bench)
    assert {i: tuple(r)[1:] for i, r in by_id(corpus_pipeline.run(spark, sf)).items()} == plain_pipeline(dict(enumerate(texts)), [item])
    empty = folder(tmp_path / "empty", documents=odd.limit(0), benchmark=bench.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns


def test_personal_data_of_one_kind_in_all_rows(spark):
    """Every document has an e-mail of one domain and the same words: the rows of these keys are dealt out over tasks."""
    texts = [f"mail number{i % 7} to user{i}@same.example about it" for i in range(1500)] + [f"nothing {i}" for i in range(1500)]
    rows = by_id(personal_data.summary(frame(spark, texts)))
    assert all(rows[i].n_email == 1 for i in range(1500)) and not any(rows[i].n_email for i in range(1500, 3000))
    want = revealing_spans(texts)
    for i in (0, 700, 1499, 2000):
        assert sorted((int(a), int(z)) for k, a, z in (x.split(":") for x in rows[i].spans.split(",") if x) if k in ("term", "gen")) == want[i]


def test_tokenizer_groups_are_bounded():
    n, most = sentencepieces.TEXTS_AT_ONCE, sentencepieces.CHARACTERS_AT_ONCE
    texts = ["a", None, "", "b" * (most + 1), *["c"] * (n + 5), "d" * (most - 1), "ee"]
    got = list(sentencepieces._groups(texts))
    assert [t for g in got for t in g] == [t or "" for t in texts] and list(sentencepieces._groups([])) == []
    assert all(len(g) <= n and (len(g) == 1 or sum(map(len, g)) <= most) for g in got) and len(got) == 6
