"""Each operator against a brute-force version, on rows with nulls, empties, repeats and long texts."""

import hashlib
import random
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import chat, components, embeddings, media, mixing, packing, pii, sharding, simhash, token_files, tokens, toxicity

KEY = b"key of the tests"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, fp int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéßñ ") for _ in range(r.randint(2, 9))).strip() or "x" for _ in range(n))


def rows():
    base = words(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    texts = [base, base, near, None, "", "   \t\n ", "one", "two words", "A.B!! c,d. E", words(2, 12_000), words(3, 300), words(4, 40), "x" * 5000, "é. ü, İstanbul ΣΑΣ. don't <|endoftext|>"]
    out = [(k, t, None if k == 1 else "en", None if k == 2 else f"s{k % 3}", None if t is None else len(t), 0.5, "clash", 7) for k, t in enumerate(texts)]
    return out + [out[0], out[3], (None, "no id", "en", "s0", 5, 0.0, "", 1), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def exact_ids(text):
    tok = tokens.worker_tokenizer(tokens.vocabulary_path())
    return np.array(tok.encode_exact(text) + [1], np.uint32)


def test_word_cache_gives_the_librarys_ids():
    import pyarrow as pa

    texts = [r[1] for r in rows()] + ["a..b c", "x́y ź", "a\xa0b c　d.", "ǅ ﬁ.", "a1b2, 3.", "'s 's. s's", "x\x1cy \x85 z", "ſ K", "we'll, they've."]
    for cache in (10, 200_000):
        tok = tokens.WordTokenizer(tokens.vocabulary_path(), cache)
        ids, n = tok.encode_many(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        for text, stop, count in zip(texts, ends, n):
            assert ids[stop - count : stop].tolist() == tok.encode_exact(text)


# 1 -------------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 100, 1009):
        net = pii.Feistel(b"k", "t", n)
        image = [net.permute(x) for x in range(n)]
        assert sorted(image) == list(range(n))
        assert [net.restore(y) for y in image] == list(range(n))


@pytest.mark.parametrize(
    "text, kind",
    [("4111 1111 1111 1111", "card"), ("4041894974608795", None), ("+1 (988) 555-2485", "phone"), ("+1 (017) 555-7713", "phone"), ("212-555-0187", "phone"), ("017-555-0187", None), ("9807915762804490", None), ("42.144.35.254", "ipv4"), ("300.1.1.1", None), ("ab.24@mail6.example.com", "email"), ("DE89 3704 0044 0532 0130 00", "iban"), ("DE88370400440532013000", None), ("2024-02-29", "date_iso"), ("2023-02-29", None), ("31.12.1999", "date_dmy"), ("12/31/1999", "date_dmy"), ("078-05-1120", "ssn"), ("000-05-1120", None), ("+44 20 7946 0958", "phone"), ("1.2.3", None), ("", None)],
)
def test_pii_kinds_keep_their_format(text, kind):
    if kind is None and text == "4041894974608795":
        kind = "card" if pii.luhn_digit(text[:-1]) == text[-1] else None
    new, spans = pii.Pseudonyms(KEY).apply(f"see {text} now")
    assert [s[2] for s in spans] == ([kind] if kind else [])
    if kind:
        inner = new[4:-4]
        assert inner != text and new[:4] == "see " and new[-4:] == " now"
        if kind != "ipv4":
            assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", inner)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", text))
        assert pii.Pseudonyms(KEY, restore=True).apply(new)[0] == f"see {text} now"
        assert pii.Pseudonyms(b"other").apply(f"see {text} now")[0] != new


def swapped(text):
    """The pseudonym of one value."""
    new, spans = pii.Pseudonyms(KEY).apply(f"see {text} now")
    assert len(spans) == 1 and spans[0][:2] == (4, 4 + len(text)), (text, spans)
    return new[4:-4]


def test_pii_links_spellings_of_one_value():
    r = random.Random(11)
    digits = lambda s: re.sub(r"\D", "", s)
    for _ in range(300):
        a, b, c = r.randint(200, 999), r.randint(200, 999), r.randint(0, 9999)
        forms = [f"{a}-{b}-{c:04d}", f"({a}) {b}-{c:04d}", f"{a}.{b}.{c:04d}", f"1-{a}-{b}-{c:04d}", f"+1 {a}-{b}-{c:04d}", f"+1 ({a}) {b}-{c:04d}", f"+1{a}{b}{c:04d}"]
        if b % 100 != 11 and a % 100 != 11:
            forms.append(f"{a}{b}{c:04d}")
        assert len({digits(swapped(f))[-10:] for f in forms}) == 1
        day = pii.datetime.date.fromordinal(r.randrange(pii.FIRST_DAY, pii.FIRST_DAY + pii.DAYS))
        y, m, d = day.year, day.month, day.day
        read = []
        for form, order in ((f"{y}-{m:02d}-{d:02d}", "ymd"), (f"{y}/{m}/{d}", "ymd"), (f"{d:02d}.{m:02d}.{y}", "dmy"), (f"{d}/{m}/{y}", "dmy"), (f"{d}-{m:02d}-{y}", "dmy"), *([(f"{m:02d}/{d:02d}/{y}", "mdy"), (f"{m}/{d}/{y}", "mdy")] if d > 12 else [])):
            new = swapped(form)
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", form)
            read.append(tuple(int(re.split(r"\D", new)[order.index(k)]) for k in "ymd"))
        assert len(set(read)) == 1 and pii.datetime.date(*read[0])
    assert swapped("A.b@x.org").lower() == swapped("a.b@x.org") and swapped("A.b@x.org")[0].isupper()
    assert swapped("josé.núñez@x.org") != "josé.núñez@x.org" and swapped("JOSÉ.Núñez@x.org").lower() == swapped("josé.núñez@x.org")
    assert swapped("+353 1 234 5678").startswith("+353 ") and swapped("+49 30 123456").startswith("+49 ")


def test_pii_restores_every_kind_and_form():
    r = random.Random(12)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = lambda n: (c := r.choice("3456") + num(n - 2)) + pii.luhn_digit(c)
    made = {
        "card": lambda: r.choice([card(13), card(15), card(16), card(19), (c := card(16))[:4] + "-" + c[4:8] + "-" + c[8:12] + "-" + c[12:]]),
        "iban": lambda: "DE" + pii._iban_check("DE", a := num(18)) + a,
        "ssn": lambda: f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        "phone": lambda: r.choice([f"({r.randint(200, 999)}) {num(3)}-{num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{r.choice(['44', '353', '7', '49'])} {num(2)} {num(4)} {num(4)}", f"{r.randint(200, 999)}.{num(3)}.{num(4)}"]),
        "ipv4": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "date": lambda: r.choice(["{0}-{1:02d}-{2:02d}", "{0}/{1}/{2}", "{2}.{1}.{0}", "{2:02d}/{1:02d}/{0}", "{1}/{2}/{0}", "{2}-{1:02d}-{0}"]).format(r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)),
        "email": lambda: "".join(r.choice("abcXYZ019ñé._") for _ in range(r.randint(1, 12))).strip("._") + "q@mail.example.org",
    }
    seen = {}
    for k in range(4000):
        kind = list(made)[k % len(made)]
        value = made[kind]()
        source = f"see {value}, now"
        new, spans = pii.Pseudonyms(KEY).apply(source)
        assert spans, value
        assert pii.Pseudonyms(KEY, restore=True).apply(new)[0] == source, (source, new)
        if kind in ("card", "ssn", "ipv4"):
            assert seen.setdefault((kind, new), value) == value
    assert pii._network.cache_info().currsize <= 1024


def test_pii_finds_cards_and_ibans_before_other_groups():
    r = random.Random(4)
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", *(c + pii.luhn_digit(c) for c in (f"4{r.randrange(10**14):014d}" for _ in range(200)))]
    ibans = ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]
    cases = [("card", c, t) for c in cards for t in (" 12/27", " 123", " 12 27", "-123")] + [("iban", i, t) for i in ibans for t in (" BY", " 12", " TO ALL", " PAID 2024")]
    for kind, value, tail in cases:
        source = f"see {value}{tail} now"
        new, spans = pii.Pseudonyms(KEY).apply(source)
        assert spans[0][0] == 4 and spans[0][1] >= 4 + len(value) and spans[0][2] == kind
        assert new[4 : 4 + len(value)] != value and pii.Pseudonyms(KEY, restore=True).apply(new)[0] == source
    new, spans = pii.Pseudonyms(KEY).apply("see 4111 1111 1111 1111 12/27")
    assert spans == [(4, 23, "card")] and new.endswith(" 12/27") and pii.luhn_digit(re.sub(r"\D", "", new[4:23])[:-1]) == new[22]
    assert pii.Pseudonyms(KEY).apply("see ES91 2100 0418 4502 0005 1332 BY")[1] == [(4, 33, "iban")]


def test_pii_gives_one_pseudonym_whatever_follows():
    """Over all tails of two and three digits, and of two letters."""
    digits = [f" {k:0{n}d}" for n in (2, 3) for k in range(10**n)]
    letters = [f" {a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    cases = [(c, digits) for c in ("4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "6304 0000 0000 0000 00" + pii.luhn_digit("630400000000000000"))]
    cases += [(i, digits + letters) for i in ("ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947")]
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, restore=True)
    for value, tails in cases:
        found = set()
        for tail in tails:
            source = f"see {value}{tail}/27 now"
            new, spans = there.apply(source)
            found.add((new[: 4 + len(value)], spans[0]))
            assert back.apply(new)[0] == source
        assert len(found) == 1 and next(iter(found))[0] != f"see {value}"


def test_hot_ids_are_dealt_out(spark):
    """A third of the rows without a doc_id, a third with one and the same, many of them equal."""
    rows = [(None, f"text {k % 50}", "a") for k in range(3000)] + [(5, f"other text {k % 3}", "b") for k in range(3000)] + [(k, f"text of {k}", "a") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = token_files.token_file_digests(docs).orderBy("start").collect()
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()] and len(got) == len(rows)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids)
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows)
    for source in "ab":
        own = [r for r in taken if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5) and all(0 <= r.taken <= 2 * r.size for r in own)


def test_pii_links_equal_values_and_keeps_rows(spark, docs, none):
    out = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame([(1, "mail a.b1@x.org"), (2, "a.b1@x.org, 10.0.0.1"), (3, None)], "doc_id long, text string"), KEY).collect()}
    assert out[1].text.split()[1] == out[2].text.split(",")[0] != "a.b1@x.org"
    assert (out[2].n_pii, out[2].kinds, out[3].text, out[3].n_pii) == (2, "email,ipv4", None, 0)
    got = pii.pseudonymise(docs.withColumn("pii_spans", F.lit("clash")), KEY)
    assert got.columns == [*docs.columns, "pii_spans"] and got.count() == len(rows())
    assert pii.pseudonymise(none, KEY).count() == 0
    with pytest.raises(ValueError, match=pii.KEY_SETTING):
        pii.pseudonymise(docs)
    spark.conf.set(pii.KEY_SETTING, KEY.decode())
    try:
        assert pii.pii_report(docs).subtract(pii.pii_report(docs, KEY)).count() == 0
    finally:
        spark.conf.unset(pii.KEY_SETTING)


# 2 -------------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark, docs, none):
    r = random.Random(5)
    data, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = [r.choice(["the", "cat", "sat", "mat", "dog", "sun", "sky", "sea"]) for _ in range(30)]
        if bad:
            w[r.randrange(30)] = r.choice(["idiot", "moron"])
        data.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5000, None), (0, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(d, lab).collect()}
    assert len(got) == 600 and all(x.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, x in got.items())
    held = [k for k in got if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in held]) > 0.95
    # labels of the held-out fold are never seen
    flipped = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels] + [(0, 1)], "doc_id long, toxic int")
    assert {x.doc_id: x.score for x in toxicity.toxicity(d, flipped).collect()} == {k: x.score for k, x in got.items()}
    model = toxicity.train(d, lab)
    odd = toxicity.score(docs, model)
    assert odd.count() == len(rows()) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(docs, lab).columns == docs.columns
    assert toxicity.toxicity(docs, lab.limit(0)).select("predicted").distinct().count() <= 2


def slow_ftrl(rows, labels, epochs):
    """FTRL-proximal one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((toxicity.BETA + np.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for row, y in zip(rows, labels):
            at = [*row, "bias"]
            w = {i: weight(i) for i in at}
            p = 1 / (1 + np.exp(-sum(w.values())))
            g = (p - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
            for i in at:
                sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_against_one_coordinate_at_a_time():
    r = random.Random(6)
    rows = [sorted(r.sample(range(200), r.randint(0, 12))) for _ in range(400)]
    labels = np.array([float(any(i < 8 for i in row)) for row in rows])
    at, w = toxicity.ftrl([np.array(row, np.int64) for row in rows], labels, epochs=3, size=200)
    want = {200 if i == "bias" else i: v for i, v in slow_ftrl(rows, labels, 3).items()}
    assert set(at.tolist()) == set(want) and 3 < len(want) < 150  # L1 leaves few
    assert all(v == pytest.approx(want[i]) for i, v in zip(at.tolist(), w))


def test_toxicity_fits_on_a_bounded_sample(spark):
    d = spark.createDataFrame([(k, f"word{k} " * 100) for k in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    whole, some = toxicity.train(d, lab), toxicity.train(d, lab, fit_bytes=3000)
    assert len(some[0]) < len(whole[0]) and len(toxicity.train(d, lab, fit_bytes=0)[0]) == 0


def test_features_cover_pairs_and_skips():
    import pyarrow as pa

    row, place = toxicity.features(pa.array(["A b, c", "", None, "b c"]))
    assert np.bincount(row, minlength=4).tolist() == [6, 0, 0, 3]
    assert set(place[row == 3]) <= set(place[row == 0])


# 3 -------------------------------------------------------------------------------------


def check_pieces(pieces, texts):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for seq in by.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == np.cumsum([0, *(p.length for p in seq)])[:-1].tolist()
        n = sum(p.length for p in seq)
        assert n & (n - 1) == 0 and n <= 2048
    ids = {k: exact_ids(t) for k, t in texts.items()}
    for k, x in ids.items():
        own = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
        assert np.concatenate([x[p.start : p.start + p.length] for p in own]).tolist() == x.tolist()
        assert all(p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(x) for p in own)


def test_packing_holds_each_id_once(spark, docs, none):
    unique = [r for r in rows()[:14]]
    pieces = packing.pack_documents(spark.createDataFrame(unique, DOCS)).collect()
    check_pieces(pieces, {r[0]: r[1] for r in unique})
    assert packing.pack_documents(none).count() == 0
    total = packing.pack_documents(docs).agg(F.sum("length")).first()[0]
    assert total == sum(len(exact_ids(r[1])) for r in rows())


def test_pack_lengths_fills_every_sequence():
    r = random.Random(3)
    lengths = [r.randint(1, 5000) if k % 9 else 2048 for k in range(500)]
    plan = packing.pack_lengths(lengths)
    assert all(sum(n for _, _, n in p) == tier for tier, p in plan)
    seen = sorted((d, s, n) for _, p in plan for d, s, n in p)
    for d, n in enumerate(lengths):
        own = [(s, m) for e, s, m in seen if e == d]
        assert [s for s, _ in own] == np.cumsum([0, *(m for _, m in own)])[:-1].tolist() and sum(m for _, m in own) == n
    assert sum(tier < 256 for tier, _ in plan) <= 8
    groups = packing.step_groups(plan)
    assert len(groups) == len(plan) and all(len({t for (t, _), g in zip(plan, groups) if g == x}) == 1 for x in set(groups))


# 4 -------------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, none, tmp_path):
    got = media.media_digests(docs).collect()
    texts = sorted(((r[0] is None, r[0] or 0), (r[1] or "").encode()) for r in rows())
    for (_, raw), g in zip(texts, sorted(got, key=lambda g: ((g.doc_id is None, g.doc_id or 0), g.n_bytes))):
        if g.doc_id is None:
            continue
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        (tmp_path / "x.wav").write_bytes(stored := media.wav_bytes(pay))
        with wave.open(str(tmp_path / "x.wav")) as w:
            assert w.readframes(w.getnframes()) == pay
        assert (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_digests(none).count() == 0


def slow_landmarks(samples):
    """Peaks and pairs by the plain sums of the Fourier transform, one frame and one bin at a time."""
    x = [float(v) - 128 for v in samples]
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / 191) for k in range(192)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(97), np.arange(192)) / 192)
    power = [[abs(sum(turn[b] * np.array([x[at + k] * hann[k] for k in range(192)]))) ** 2 for b in range(97)] for at in range(0, len(x) - 191, 96)]
    bands = [(2, 10), (10, 20), (20, 40), (40, 97)]
    best = [[max(p[a:b]) for a, b in bands] for p in power]
    peaks = []
    for t, p in enumerate(power):
        for k, (a, b) in enumerate(bands):
            v = best[t][k]
            if v > (best[t - 1][k] if t else -1) and v >= (best[t + 1][k] if t + 1 < len(best) else -1) and v > 3 * sum(p[a:b]) / (b - a):
                peaks.append((t, a + p[a:b].index(v)))
    return peaks, sorted((t << 24) | (f << 16) | (g << 8) | (u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 4] if u - t <= 64)


def test_peaks_and_landmarks_against_plain_sums(docs):
    found = 0
    for k, n in enumerate((0, 100, 200, 300, 500, 900, 2500)):
        raw = words(20 + k, max(1, n // 6)).encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        peaks, codes = slow_landmarks(payload)
        t, f = media.spectral_peaks(np.frombuffer(payload, np.uint8))
        assert list(zip(t.tolist(), f.tolist())) == peaks and media.landmarks(t, f).tolist() == codes
        found += len(codes)
    assert found > 20
    for r in media.media_digests(docs).collect():
        assert r.feature.split(":")[1:] == [str(len(r.landmarks)), xxhash.xxh64_hexdigest(np.array(r.landmarks, "<i8").tobytes())]


def test_few_peaks_still_make_landmarks():
    at = lambda *x: np.array(x, np.int64)
    assert media.landmarks(at(0, 1), at(5, 9)).tolist() == [5 << 16 | 9 << 8 | 1]
    assert len(media.landmarks(at(0, 0, 1), at(5, 9, 7))) == 3
    assert len(media.landmarks(at(0), at(5))) == len(media.landmarks(at(), at())) == 0


def test_media_digests_read_stored_media(docs, monkeypatch):
    tags = []
    monkeypatch.setattr(media, "written", lambda df, tag, f=media.written: tags.append(tag) or f(df, tag))
    assert media.media_digests(docs).count() == len(rows()) and tags == ["media"]


def test_spectral_peaks_find_a_tone():
    t = np.arange(16_000)
    tone = (128 + 100 * np.sin(2 * np.pi * 30 / media.FRAME * t) * (1 + (t // 800) % 2)).astype(np.uint8)
    frame, bins = media.spectral_peaks(tone)
    assert len(frame) and set(bins[(bins >= 20) & (bins < 40)]) == {30}
    codes = media.landmarks(frame, bins)
    assert (np.diff(codes) >= 0).all() and media.spectral_peaks(np.zeros(10, np.uint8))[0].size == 0


# 5 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()
    lengths = np.array([4000, 1, 6000])
    box = token_files.Container(token_files.container(np.array([3, 5, 9]), lengths, ids, bits))
    assert (box.ids(0, len(ids)) == ids).all() and (box.ids(4095, 3) == ids[4095:4098]).all()
    assert (box.document(2) == ids[4001:]).all() and box.document(1).tolist() == ids[4000:4001].tolist()


def test_token_files(docs, none):
    got = sorted(token_files.token_file_digests(docs).collect(), key=lambda g: g.start)
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for g, r in zip(got, want):
        ids = exact_ids(r[1])
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(want) and token_files.token_file_digests(none).count() == 0


# 6 -------------------------------------------------------------------------------------


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(prints))])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_and_components(docs, none):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows())
    prints = {r[0]: slow_print(r[1]) for r in rows() if r[0] is not None}
    ids = sorted(prints)
    label = slow_components(np.array([prints[k] for k in ids], np.uint64))
    want = {k: ids[label[i]] for i, k in enumerate(ids)}
    for g in got:
        if g.doc_id is not None:
            assert int(g.fingerprint, 16) == prints[g.doc_id] and g.component_id == want[g.doc_id]
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.keep_one(docs)
    stay = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in stay if r.doc_id is not None} == set(want.values())
    assert len(stay) == len({r.component_id for r in got})


@pytest.mark.parametrize("bucket", [3, 256])
def test_links_join_what_all_pairs_join(spark, bucket):
    """A dense cloud around one fingerprint, chains, and random ones; hot buckets take the exact way for them."""
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(300)}
    for center in (r.getrandbits(64), (1 << 64) - 1, 0):
        prints |= {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    x = r.getrandbits(64)
    for _ in range(60):
        prints.add(x := x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    all_ = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in all_.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, bucket)
    comp = {c.node: c.component for c in components.connected_components(links).collect()}
    label = slow_components(all_)
    got = {}
    for k, v in enumerate(all_.view(np.int64).tolist()):
        got.setdefault(comp.get(v, v), set()).add(k)
    want = {}
    for k, v in enumerate(label):
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pivot_tables_never_part_near_fingerprints():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64))
    tx, ty = simhash.distance_table(x).astype(int), simhash.distance_table(y).astype(int)
    assert np.abs(tx - ty).max() <= 2
    assert (simhash.meeting_keys(tx.astype(np.uint8)) == simhash.meeting_keys(ty.astype(np.uint8))).any(axis=1).all()


def test_connected_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(1, 1), (2, 3), (3, 2)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {7} == {got[7]}
    assert got[2] == got[3] == 2 and 1 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "a[/INST]</s>b", "\\l \\\\ \\b < [", "[/INST]", "[/INST]</s>", "<s>=user[INST]x[/INST]</s>", "", None, "plain é\n\n", "x" * 20000, "[/INST]</s" ]
    turns = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], hard[(c * 3 + t) % len(hard)], 1) for c in range(12) for t in range(c % 5 + 1)]
    turns += [(None, 0, "user", "q", 1), (3, 1, "assistant", "tie", 1), (3, 1, "assistant", "tie", 1), (4, None, "assistant", "no turn", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text, _ in turns:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        g, loss = got[c], "".join(x[3] for x in ts if x[2] == "assistant")
        assert g.n_turns == len(ts)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in ts).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    formatted = [r.formatted for r in chat.format_conversations(df).collect()] + [chat.format_conversations(chat.conflict_conversation(spark)).first().formatted]
    for whole in formatted:  # control strings stand at the template's own places alone
        turns = strict_parse(whole)
        assert all(whole.count(c) == len(turns) for c in ("<s>", "[INST]", "</s>", "[/INST]"))
    assert formatted[-1] == "<s>~user[INST]\\l/s>\\kINST] ok \\k/INST][/INST]</s><s>~assistant[INST]\\l/s>\\kINST] ok \\k/INST][/INST]</s>"


def strict_parse(s):
    """[(mark, role, text)] as written, by a parser that reads on or fails."""
    turns, at = [], 0
    while at < len(s):
        assert s.startswith("<s>", at) and s[at + 3] in "=~"
        role_end = s.index("[INST]", at + 4)
        text_end = s.index("[/INST]</s>", role_end + 6)
        turns.append((s[at + 3], s[at + 4 : role_end], s[role_end + 6 : text_end]))
        at = text_end + 11
    return turns


def test_chat_parser_takes_all_or_nothing(spark):
    good = "<s>=user[INST]hi[/INST]</s>"
    cases = [(good, 1), (good + good, 2), ("", 0), ("x" + good, None), (good + " ", None), (good + "x" + good, None), ("<s>=user[INST]a<s>b[/INST]</s>", None), ("<s>=us</s>er[INST]ab[/INST]</s>", None), ("<s>?user[INST]a[/INST]</s>", None), ("<s>~u[INST]\\k\\l\\b[/INST]</s>", 1)]
    got = spark.createDataFrame([(s,) for s, _ in cases], "s string").select(chat.parse(F.col("s")).alias("t")).collect()
    assert [None if r.t is None else len(r.t) for r in got] == [n for _, n in cases]
    assert got[-1].t[0].text == "[<\\"


# 8 -------------------------------------------------------------------------------------


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    vec = [base[k % 40] + r.normal(size=16) * 0.08 * (k % 3) for k in range(300)]
    data = [(k, v.astype(np.float32).tolist(), None if k % 50 == 49 else k % 40 % 3) for k, v in enumerate(vec)]
    data += [(300, data[0][1], data[0][2]), (301, data[0][1], data[0][2]), (302, [0.0] * 16, 1), (303, None, 1), (304, [], 1), (305, [float("nan")] * 16, 1), (306, [None] * 16, 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (309, [float("inf")] * 16, 1), (309, [-0.0] + [1.0] * 15, 2), (310, [0.0] + [1.0] * 15, 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = embeddings.embedding_components(df).collect()
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    near = np.eye(len(data), dtype=bool)
    for i, a in enumerate(data):
        for j, b in enumerate(data):
            if i != j and a[2] is not None and a[2] == b[2] and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                near[i, j] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    label = np.arange(len(data))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(data))])
        if (new == label).all():
            break
        label = new
    want = sorted((d[0], int(near[k].sum()) - 1, data[label[k]][0], d[0] == data[label[k]][0]) for k, d in enumerate(data))
    assert sorted(map(tuple, got)) == want
    assert embeddings.embedding_components(df.limit(0)).count() == 0


def test_join_intervals_finds_all_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 8))
    x[450:] = x[:450] + r.normal(size=(450, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.argsort(x[:, 0])]
    i, j = embeddings.join_intervals(x, x, x[:, :2], x[:, :2], True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)))}
    assert {*zip(i.tolist(), j.tolist())} == want and len(i) == len(want)
    i, j = embeddings.join_intervals(x[:500], x[500:], x[:500, :2], x[500:, :2], False)
    assert {*zip(i.tolist(), (j + 500).tolist())} == {(a, b) for a, b in want if a < 500 <= b}


# 9 -------------------------------------------------------------------------------------


def test_shards_are_level_and_gapless(spark, docs, none):
    many = spark.range(5000).select("id", F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 700 as int))").alias("text"), F.lit(9).alias("shard"))
    got = sharding.shard_documents(many).toPandas()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 24 and per.max() - per.min() < 1000 and per.sum() == sum(k % 700 + 8 for k in range(5000))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    odd = sharding.shard_documents(docs).collect()
    assert sorted((o["size"], o.text_crc32) for o in odd) == sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sharding.shard_documents(none).count() == 0


def test_rebalance_moves_little(spark, tmp_path):
    r = random.Random(1)
    sums = {s: r.randint(900, 1100) for s in range(4096)}
    old = sharding.deal_slots(sums, 24)
    new = sharding.rebalanced(old, sums, 25)
    moved = [s for s in sums if new[s] != old[s]]
    load = [sum(n for s, n in sums.items() if new[s] == t) for t in range(25)]
    assert {new[s] for s in moved} == {24} and len(moved) < 4096 / 25 * 1.3 and max(load) < 1.05 * sum(load) / 25
    fewer = sharding.rebalanced(new, sums, 24)
    assert max(fewer.values()) == 23 and all(fewer[s] == new[s] for s in sums if new[s] < 24)
    table = spark.createDataFrame([(s, n, 1) for s, n in sums.items()], "vslot int, bytes long, rows long")
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    store.create(table, 24)
    store.rebalance(0, table, 25)
    assert {x.vslot: x.shard for x in store.read(0).collect()} == old and {x.vslot: x.shard for x in store.read(1).collect()} == new


# 10 ------------------------------------------------------------------------------------


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(spark, docs, none):
    r = random.Random(8)
    data = [(k, " ".join("w" * r.randint(0, 40)), r.choice(["a", "b", "c", "dd", "é", None, "hot", "hot", "hot", "hot"])) for k in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("cut", F.lit(2))
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    taken = {}
    for g in got:
        assert g.target == pytest.approx(want[g.source]) and g.source_size == sizes[g.source] and 0 <= g.taken <= 2 * g.size
        taken[g.source] = taken.get(g.source, 0) + g.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    digits = mixing.range_digits
    assert [digits(n) for n in (0, 10**7, 10**9, 10**11)] == [2, 2, 4, 6] and digits(mixing.RANGE_ROWS << 8) == 2
    mixing.range_digits = lambda rows: 4
    try:
        assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    finally:
        mixing.range_digits = digits
    no_id = mixing.mix(df.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))).groupBy("source", "target").agg(F.sum("taken").alias("n"))
    assert all(abs(x.n - x.target) <= 1 for x in no_id.collect())
    assert mixing.mix(docs).count() == len(rows()) and mixing.mix(none).count() == 0
    assert mixing.mix_rows(docs).columns == docs.columns and mixing.mix_rows(none).count() == 0
    copies = {x.doc_id: x["count"] for x in mixing.mix_rows(df).groupBy("doc_id").count().collect()}
    assert copies == {g.doc_id: -(-g.taken // g.size) for g in got if g.taken}


def test_keep_one_keeps_a_row_of_every_group(spark):
    rows = [(3, "a b c d", "x"), (1, "A  b c d", "y"), (None, "other words here", "z"), (None, "other words here", "y"), (7, "not like the rest of them", "w"), (7, "not like the rest of them", "w"), (7, "one id but another text", "w"), (9, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep_one(docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and got == sorted([(1, "A  b c d"), (None, "other words here"), (7, "not like the rest of them"), (7, "one id but another text"), (9, None)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_far_pivots_discard_pairs():
    r = np.random.default_rng(5)
    near = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    bucket = np.unique(np.concatenate([r.integers(0, 1 << 63, 200, dtype=np.uint64), near, near ^ np.uint64(3)]))
    met, left, close = simhash.pivot_shares([bucket])
    want = sum(int(np.bitwise_count(a ^ b)) <= 2 for i, a in enumerate(bucket) for b in bucket[i + 1 :])
    assert close == want >= 20 and close <= left < met / 1000
