"""Chat formatting, PNG hashes, wrapper induction, language ID, WARC archives."""

import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from cairn.llm import chat, langid, media, warc, wrapper
from pyspark.sql import functions as F

# ------------------------------------------------------------------ chat

CHAT = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
part = lambda kind, **kw: tuple(kw.get(k) if k != "type" else kind for k in ("type", "text", "uri", "width", "height", "seconds", "pages"))


def talks(spark, rows):
    df = spark.createDataFrame(rows, CHAT).withColumn("prompt", F.lit("x")).withColumn("all", F.lit(1))
    return {r["conv_id"]: r for r in chat.format_chat(df).collect()}


def test_chat_parts_are_numbered_in_order(spark):
    rows = [
        (1, 2, "assistant", [part("text", text="Two things."), part("document", uri="d", pages=3)]),
        (1, 1, "user", [part("image", uri="i", width=57, height=28), part("text", text="see "), part("audio", uri="s", seconds=1.0)]),
    ]
    r = talks(spark, rows)[1]
    assert r["prompt"] == "<|user|>\n<|image_1|>see <|audio_2|><|end|>\n<|assistant|>\nTwo things.<|document_3|><|end|>\n"
    assert r["attachments"] == "1 image i 5\n2 audio s 15\n3 document d 770"
    assert (r["n_messages"], r["n_text_tokens"], r["n_expanded_tokens"]) == (2, 4, 794)


def test_chat_edge_rows(spark):
    long = "word " * 100_000
    rows = [(1, 1, None, None), (1, 2, "user", []), (None, 1, "user", [part("text", text="null id")]), (2, 1, "user", [part("video", uri="v"), part(None), part("text"), part("image")]),
            (3, 1, "user", [part("text", text="twice")]), (3, 1, "user", [part("text", text="twice")]), (4, 1, "user", [part("text", text=long)]), (5, None, "user", [part("text", text="b")]), (5, 1, "user", [part("text", text="a")])]
    r = talks(spark, rows)
    assert r[1]["prompt"] == "<|unknown|>\n<|end|>\n<|user|>\n<|end|>\n" and r[None]["prompt"] == "<|user|>\nnull id<|end|>\n"
    assert r[2]["prompt"] == "<|user|>\n<|unsupported:video|><|unsupported:null|><|image_1|><|end|>\n" and r[2]["attachments"] == "1 image - 2"
    assert r[3]["n_messages"] == 2 and r[3]["prompt"].count("twice") == 2 and r[4]["n_text_tokens"] == 100_000
    assert r[5]["prompt"] == "<|user|>\nb<|end|>\n<|user|>\na<|end|>\n"
    assert chat.format_chat(spark.createDataFrame([], CHAT)).count() == 0


# ------------------------------------------------------------------ media


@pytest.mark.parametrize("colour, depth", [(c, d) for c, ds in media.DEPTHS.items() for d in ds])
def test_png_round_trip(colour, depth):
    r = np.random.default_rng(depth)
    c = media.CHANNELS[colour]
    for h, w in ((1, 1), (7, 13), (40, 33)):
        x = r.integers(0, 1 << depth, (h, w, c))
        palette = bytes(r.integers(0, 256, 3 << depth, dtype=np.uint8)) if colour == 3 else b""
        for filters in range(5):
            i = media.Image(media.encode(x, colour, depth, filters, palette))
            out = media.samples(media.unfilter(i.lines[0][None], i.bpp), w, c, depth)[0]
            assert (out == x).all()


def test_png_interlaced():
    x = np.random.default_rng(0).integers(0, 256, (11, 9))
    raw = b"".join(b"\0" + x[y, a::sx].astype(np.uint8).tobytes() for a, b, sx, sy in media._ADAM7 if a < 9 for y in range(b, 11, sy))
    chunk = lambda k, body: struct.pack(">I4s", len(body), k) + body + struct.pack(">I", zlib.crc32(k + body))
    png = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 11, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    i = media.Image(png)
    full = np.zeros((11, 9))
    for k, first, block in i.bands():
        a, b, sx, sy = i.passes[k]
        full[b::sy, a::sx] = media.light(media.samples(media.unfilter(block[None], 1), i.shapes[k][1], 1, 8), [i])[0]
    assert np.allclose(full * 255, x) and np.allclose(media.grid([i])[0], reduced(full))


def reduced(grey):
    """32x32 averages by their definition."""
    h, w = grey.shape
    out = [[0.0] * 32 for _ in range(32)]
    for r in range(32):
        for c in range(32):
            for y in range(r * h // 32, min(h, -(-(r + 1) * h // 32))):
                for x in range(c * w // 32, min(w, -(-(c + 1) * w // 32))):
                    over = max(0, min((r + 1) * h / 32, y + 1) - max(r * h / 32, y)) * max(0, min((c + 1) * w / 32, x + 1) - max(c * w / 32, x))
                    out[r][c] += grey[y][x] * over * 32 * 32 / (h * w)
    return np.array(out)


def plain_hash(grey):
    """The hash by a double sum over the averages."""
    small = reduced(grey)
    low = [round(sum(small[y, x] * math.cos(math.pi * (y + 0.5) * u / 32) * math.cos(math.pi * (x + 0.5) * v / 32) for y in range(32) for x in range(32)), 9) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return int("".join(str(int(k > 0 and c > middle)) for k, c in enumerate(low)), 2).to_bytes(8, "big")


def by_hand(x, colour, kind, palette=b""):
    """A PNG of 8-bit samples made without the module: every row has the filter ``kind``, a chunk of its own, and there is a text chunk."""
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    h, w, c = x.shape
    z, before, body = zlib.compressobj(1), bytes(w * c), []
    for y in range(h):
        row = bytes(int(v) for v in x[y].ravel())
        line = bytearray([kind])
        for p, v in enumerate(row):
            left, up, corner = row[p - c] if p >= c else 0, before[p], before[p - c] if p >= c else 0
            near = min((abs(left + up - corner - s), k, s) for k, s in enumerate((left, up, corner)))[2]
            line.append((v - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        body.append(z.compress(bytes(line)) + z.flush(zlib.Z_SYNC_FLUSH))
        before = row
    body[-1] += z.flush()
    extra = chunk(b"PLTE", palette) if palette else b""
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"Comment\0x") + extra + b"".join(chunk(b"IDAT", z) for z in body) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_hash_equals_plain_cosine_transform(spark, colour):
    r = np.random.default_rng(colour)
    rows, want = [], {}
    palette = r.integers(0, 256, (256, 3))
    for n, (h, w) in enumerate(((5, 9), (32, 32), (41, 70))):
        for kind in range(5):
            x = r.integers(0, 256, (h, w, media.CHANNELS[colour]))
            rgb = palette[x[..., 0]] if colour == 3 else x[..., :3] if colour in (2, 6) else np.repeat(x[..., :1], 3, 2)
            grey = (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]) / 255
            if colour in (4, 6):
                grey = grey * x[..., -1] / 255 + 1 - x[..., -1] / 255
            rows.append((5 * n + kind, by_hand(x, colour, kind, palette.astype(np.uint8).tobytes() if colour == 3 else b"")))
            want[5 * n + kind] = plain_hash(grey)
    got = {x["id"]: (x["status"], bytes(x["phash"])) for x in media.decode(spark.createDataFrame(rows, "id long, png binary")).collect()}
    assert got == {k: ("ok", v) for k, v in want.items()}


def test_large_image_is_decoded_in_bands(monkeypatch):
    x = np.random.default_rng(3).integers(0, 256, (300, 5000, 1))
    png = media.encode(x, 0)
    whole = media.cosine_hash(media.grid([media.Image(png)]))
    monkeypatch.setattr(media, "BAND_BYTES", 40_000)
    i = media.Image(png)
    assert not i.small and media.cosine_hash(media.grid([i])) == whole
    short = media.encode(x[:200], 0).replace(struct.pack(">II", 5000, 200), struct.pack(">II", 5000, 201))
    short = short[:29] + struct.pack(">I", zlib.crc32(short[12:29])) + short[33:]
    with pytest.raises(media.Fault, match="scanlines"):
        media.grid([media.Image(short)])


def test_palette_index_out_of_range(spark):
    x = np.full((4, 4, 1), 7)
    rows = [(1, media.encode(x, 3, palette=bytes(24))), (2, media.encode(x, 3, palette=bytes(21)))]
    got = {r["id"]: (r["status"], r["phash"] is None) for r in media.decode(spark.createDataFrame(rows, "id long, png binary")).collect()}
    assert got == {1: ("ok", False), 2: ("palette index", True)}


def test_media_edge_rows(spark):
    r = np.random.default_rng(2)
    smooth = np.kron(r.integers(0, 200, (8, 8)), np.ones((12, 12), int))[..., None]
    png = media.encode(smooth, 0)
    bad = bytearray(png)
    bad[60] ^= 1
    wide = media.SIGNATURE + struct.pack(">I4s", 13, b"IHDR") + (h := struct.pack(">IIBBBBB", 1 << 28, 1 << 20, 8, 0, 0, 0, 0)) + struct.pack(">I", zlib.crc32(b"IHDR" + h))
    rows = [(1, png), (1, png), (None, media.encode(smooth + 30, 0, filters=3)), (3, None), (4, b""), (5, bytes(bad)), (6, png[:-5]), (7, wide), (8, media.encode(np.repeat(smooth, 3, 2), 2))]
    df = spark.createDataFrame(rows, "id long, png binary").withColumn("width", F.lit("w")).withColumn("status", F.lit(0))
    out = [(x["id"], x["status"], x["phash"]) for x in media.decode(df).collect()]
    by = {i: (s, h) for i, s, h in out}
    same = by[1][1]
    assert len(out) == 9 and by[1][0] == "ok" and len(same) == 8
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    assert near(by[None][1], same) <= 4 and near(by[8][1], same) <= 2  # brightness, and grey as colour
    assert by[3] == (None, None) and by[4] == ("signature", None) and "checksum" in by[5][0] and by[6] == ("chunk cut off", None) and by[7] == ("row too long", None)
    assert media.decode(df.limit(0)).count() == 0


# ------------------------------------------------------------------ wrapper


def matched(a, b, x, y):
    """Simple tree matching by its definition."""
    if a.tag[x] != b.tag[y]:
        return 0
    p, q = a.kids[x], b.kids[y]
    m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p)):
        for j in range(len(q)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(a, b, p[i], q[j]))
    return 1 + m[-1][-1]


def test_tree_matching_equals_brute_force():
    r = random.Random(1)

    def html(depth):
        return "text" if depth == 0 or r.random() < 0.2 else "".join(f"<{t}>{html(depth - 1)}</{t}>" for t in r.choices(["div", "span", "b", "section"], k=r.randrange(1, 4)))

    for _ in range(60):
        a, b = wrapper.Tree(html(4)), wrapper.Tree(html(4))
        m = wrapper.Matcher(a, b)
        assert m.weight(0, 0) == matched(a, b, 0, 0)
        pairs = m.pairs()
        assert len(pairs) == m.weight(0, 0) and all(a.tag[x] == b.tag[y] for x, y in pairs.items()) and len(set(pairs.values())) == len(pairs)


def test_wrapper_template_and_slots(spark):
    page = lambda k, body: (k, f"http://a.org/{k}", f"<html><head><title>x</title></head><body><nav>Home</nav><div class=h>Site name</div><p>{body}<p>by author {k}<footer>All rights</footer><script>1<2</script></body>")
    rows = [page(k, f"Story &amp; {k}") for k in range(12)]
    rows += [(50, "http://lone.org/", "<p>all of it"), (51, None, "<b>no host"), (52, "http://a.org/52", None), (None, "http://a.org/n", rows[0][2]), (53, "http://a.org/53", ""), (54, "http://a.org/54", "<div>" * 3000 + "deep <!-- never"), (1, *rows[1][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("ref", F.lit(1)).withColumn("content", F.lit(2))
    got = {}
    for r in wrapper.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    for k in range(12):
        assert got[k][0]["content"] == f"Story & {k}\nby author {k}" and got[k][0]["n_template"] == 3
    assert len(got[1]) == 2 and got[50][0]["content"] == "all of it" and got[51][0]["content"] == "no host" and got[52][0]["content"] is None and got[53][0]["content"] == "" and got[54][0]["content"] == "deep"
    assert got[None][0]["content"] == "Story & 0\nby author 0"
    assert wrapper.extract(df.limit(0)).count() == 0


def test_wrapper_reads_deep_pages_of_one_host(spark):
    deep = lambda k, n: (k, f"http://d.org/{k}", "<div>" * n + f"<b>text {k}</b>" + ("<i>x</i>" if k % 2 else "<u>y</u>"))
    rows = [deep(0, 10_000), deep(1, 10_000), deep(2, 9_990), deep(3, 600)]
    got = {r["page_id"]: r["content"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith(f"text {k}") for k in range(4))


def test_wrapper_induces_what_the_reference_lacks(spark):
    a = lambda k: (k, f"http://h.org/{k}", f"<body><h1>Site</h1><p>story {k}</p><footer>About us</footer>")
    b = lambda k: (k, f"http://h.org/{k}", f"<body><h1>Site</h1><table><tr><td>Banner of the day</td></tr></table><p>story {k}</p><section><em>Share this</em><em>note {k}</em></section><footer>About us</footer>")
    rows = [a(k) for k in range(20)] + [b(k) for k in range(20, 30)]
    got = {r["page_id"]: r["content"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k}" for k in range(20)) and all(got[k] == f"story {k}\nnote {k}" for k in range(20, 30))


# ------------------------------------------------------------------ language ID


def test_langid_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang", "text")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    out = langid.identify(docs.filter(held), docs.filter(~held)).filter("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_id")).cast("int")), F.count("*")).first()
    assert out[0] >= 0.95 and out[1] > 150


def test_langid_edge_rows(spark):
    r = random.Random(1)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(30))
    rows = [(i, "aa" if i % 2 else "bb", say("abcde" if i % 2 else "vwxyz")) for i in range(40)]
    odd = [(100, None, None), (101, None, ""), (102, None, "1234 ... 5"), (None, None, say("abcde")), (103, None, say("жшщюя")), (104, None, say("vwxyz") * 2000), (0, "bb", rows[0][2])]
    df = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string").withColumn("lang_id", F.lit("q")).withColumn("similarity", F.lit(1))
    got = {}
    for x in langid.identify(df).collect():
        got.setdefault(x["doc_id"], []).append((x["lang_id"], x["similarity"]))
    assert all(got[i][0][0] == ("aa" if i % 2 else "bb") for i in range(40)) and len(got[0]) == 2 and got[0][0][1] == pytest.approx(got[0][1][1], abs=1e-5)
    assert got[100] == got[101] == got[102] == [("und", 0.0)] and got[None][0][0] == "aa" and got[103][0][0] == "und" and got[104][0][0] == "bb"
    assert langid.identify(df.limit(0)).count() == 0
    assert {x["lang_id"] for x in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ------------------------------------------------------------------ WARC


def test_warc_round_trip(spark):
    pages = [(k, f"http://x/{k}", f"<p>päge {k}</p>" * (k % 50)) for k in range(200)] + [(500, None, None), (None, "http://n", ""), (1, "http://x/1", "<p>again</p>"), (501, "http://long", "y" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit(1)).repartition(3)
    got = sorted(((str(r["fields"].get("x-page-id")), r["target_uri"], bytes(r["block"]).decode(), r["error"]) for r in warc.read_archives(warc.pack_pages(df, 20_000)).collect()), key=str)
    assert got == sorted(((str(p), u, h or "", None) for p, u, h in pages), key=str)
    assert warc.read_archives(warc.pack_pages(df.limit(0))).count() == 0
    assert warc.read_archives(spark.createDataFrame([("a", None), ("b", b"")], "archive string, content binary")).count() == 0


def test_warc_files_and_faults(spark, tmp_path):
    ok = warc.record("resource", "1", "2024-01-01T00:00:00Z", b"hello", {})
    bad = [ok.replace(b"hello", b"hellO"), ok.replace(b"Length: 5", b"Length: 99"), ok.replace(b"Length: 5", b"Length: 4"), ok.replace(b"WARC/1.1", b"HTTP/1.1"), ok.replace(b"WARC-Date", b"X-Date"), b"nothing"]
    data = warc.archive([ok, *bad, ok])
    (tmp_path / "a.warc.zst").write_bytes(data)
    (tmp_path / "cut.warc.zst").write_bytes(data[:-7])
    out = warc.read_files(spark, [str(tmp_path / "a.warc.zst")]).orderBy("offset").collect()
    assert [r["error"] for r in out] == [None, "digest", "block shorter than its length", "block longer than its length", "version line", "field missing: warc-date", "header not ended", None]
    assert bytes(out[-1]["block"]) == b"hello"
    assert [r["error"] for r in warc.read_files(spark, [str(tmp_path / "cut.warc.zst")]).collect()][-1] == "frame cut off"
    plain = zstandard.ZstdCompressor().compress(ok) * 2  # without a dictionary
    assert [r["error"] for r in warc.records(io.BytesIO(plain))] == [None, None]
    lost = data[8 + struct.unpack("<I", data[4:8])[0] :]  # the dictionary is gone
    assert [r["error"][:5] for r in warc.records(io.BytesIO(lost))] == ["frame"]


def test_warc_goes_on_after_damage():
    made = [warc.record("resource", str(k), "2024-01-01T00:00:00Z", f"body {k} ".encode() * (20 + k), {}) for k in range(20)]
    data = bytearray(warc.archive(made))
    at = [r["offset"] for r in warc.records(io.BytesIO(bytes(data)))]
    assert len(at) == 20
    want = [f"body {k} ".encode() * (20 + k) for k in range(20)]
    for spot in (at[1] + 4, at[1] + 9, at[1], at[1] + (at[2] - at[1]) // 2, at[2] - 2):
        bad = bytearray(data)
        bad[spot : spot + 2] = bytes(255 - x for x in bad[spot : spot + 2])
        got = list(warc.records(io.BytesIO(bytes(bad))))
        assert [r["block"] for r in got if r["error"] is None] == want[:1] + want[2:], spot
        assert 1 <= sum(r["error"] is not None for r in got) <= 2
    gone = bytes(data[: at[5] + 3] + data[at[6] :])
    got = list(warc.records(io.BytesIO(gone)))
    assert [r["block"] for r in got if r["error"] is None] == want[:5] + want[6:]
    noise = bytes(data[: at[3]]) + b"noise" * 20_000 + bytes(data[at[3] :])
    got = list(warc.records(io.BytesIO(noise)))
    assert [r["error"] for r in got if r["error"]] == ["not a frame"] and len(got) == 21


def test_warc_payload_digest():
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nthe page"
    of = lambda body: {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": warc.digest(body)}
    for body, fault in ((b"the page", None), (b"another", "payload digest")):
        assert warc.parse(warc.record("response", "1", "2024-01-01T00:00:00Z", http, of(body)))["error"] == fault


# ------------------------------------------------------------------ language ID, by its definition


def test_langid_equals_plain_vectors(spark):
    r = random.Random(6)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 40)))
    rows = [(i, ("aa", "bb", "cc")[i % 3], say(("abcdé", "vwXyz", "mnopq")[i % 3])) for i in range(90)] + [(200, None, "éé É 12 a"), (201, None, "qa vb"), (202, None, None), (203, None, "жж")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    idf = langid.frequencies(df)
    langs, centroids, least = langid.train(df, idf)
    letter = lambda b: b >= 128 or chr(b) in "abcdefghijklmnopqrstuvwxyz"

    def grams(text):
        x = [b if letter(b) else 32 for b in (text or "").lower().encode()]
        out = {}
        for k, b in enumerate(x):
            if b != 32:
                g = (((x[k - 1] if k else 32) << 16 | b << 8 | (x[k + 1] if k + 1 < len(x) else 32)) * 2654435761 % (1 << 32)) >> 20
                out[g] = out.get(g, 0) + 1
        return out

    texts = [t for _, _, t in rows if t is not None]
    df_of = {}
    for t in texts:
        for g in grams(t):
            df_of[g] = df_of.get(g, 0) + 1
    weight = lambda g: math.log((len(texts) + 1) / (df_of.get(g, 0) + 1)) + 1
    got = {x["doc_id"]: (x["lang_id"], x["similarity"]) for x in langid.identify(df).collect()}
    for i, _, t in rows:
        v = {g: n * weight(g) for g, n in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        sims = [sum(x * float(c[g]) for g, x in v.items()) / norm if norm else 0.0 for c in centroids]
        best = max(range(len(sims)), key=lambda k: (round(sims[k], 6), -k))
        assert got[i][1] == pytest.approx(sims[best], abs=1e-4)
        assert got[i][0] == (langs[best] if sims[best] > 0 and sims[best] >= least[best] else "und"), i
    assert {lang for lang, _ in got.values()} == {"aa", "bb", "cc", "und"}
