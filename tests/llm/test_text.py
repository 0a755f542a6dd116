import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import bpe, crf, html_extract, html_pages, langid, license_scan, packing, toxicity, webp


# ---- packing --------------------------------------------------------------------------------------


def test_pieces_and_packing(spark, odd, empty, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    for frame in (odd, empty, documents):
        rows = packing.pack_documents(frame).collect()
        wanted = []
        for r in frame.collect():
            ids = full.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            first = len(ids) % 1024 or 1024
            for n, a in enumerate([0, *range(first, len(ids), 1024)]):
                part = ids[a : first if n == 0 else a + 1024]
                wanted.append((r["doc_id"], n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(wanted, key=repr)
        held = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in held.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(r["length"] for r in rows)
        assert len(held) <= max(-(-total // 1024) * 1.02 + 1, 0) or not rows


def pack_by_hand(lengths, capacity):
    """Best fit, one piece at a time, longest first."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n and b[1] >= 1 and b[2] >= n * n]
        best = min(fits, key=lambda b: b[0], default=None)
        if best is None:
            bins.append(best := [capacity.tokens, capacity.documents, capacity.attention])
        best[0], best[1], best[2] = best[0] - n, best[1] - 1, best[2] - n * n
    return len(bins)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(100, 3, 10_000), packing.Capacity(100, 100, 4000)])
@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_under_every_capacity(capacity, choose):
    r = random.Random(9)
    lengths = [r.randint(1, min(capacity.tokens, int(capacity.attention**0.5))) for _ in range(500)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    placed, bins = packing.best_fit(histogram, capacity, choose)
    held: dict[int, list] = {}
    ranks: dict[int, list] = {}
    for length, rank, n, first, offset in placed.tolist():
        ranks.setdefault(length, []).extend(range(rank, rank + n))
        for b in range(first, first + n):
            held.setdefault(b, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for own in held.values():
        assert len(own) <= capacity.documents and sum(n * n for _, n in own) <= capacity.attention and sum(n for _, n in own) <= capacity.tokens
        assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
    assert len(held) == bins
    if choose == "norm":
        assert bins <= pack_by_hand(lengths, capacity) + 1


def test_every_dimension_decides():
    """By tokens alone, by documents alone and by attention alone the same pieces go to different bins; all three fit the bins of tokens alone."""
    r = random.Random(4)
    lengths = [r.choice((3, 5, 40, 41, 200, 333, 700)) for _ in range(400)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    placed = {w: packing.best_fit(histogram, weights=w) for w in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), packing.WEIGHTS)}
    assert all(packing.WEIGHTS) and len({p.tobytes() for p, _ in placed.values()}) >= 3
    assert placed[packing.WEIGHTS][1] <= placed[1.0, 0.0, 0.0][1]


# ---- BPE ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import tiktoken

    own = bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizers, documents):
    own, library = tokenizers
    r = random.Random(10)
    alphabet = "ab'sdtrelvmZ  \n\t!?,.'''19é中  \x1c\x85½٣\0\x01"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(5000)] + ["", None, " ", "a" * 3000, "'s's 'll", "!'s", "\n's"]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 640)]
    texts += ["".join(map(chr, range(1, 12))) * 3] + [x["text"] for x in documents.limit(40).collect()]
    for text, found in zip(texts, own.encode(texts), strict=True):
        assert found.ids.tolist() == library.encode_ordinary(text or "")
        raw = (text or "").encode()
        assert own.decode(found.ids.tolist()) == raw and found.offsets[-1] == len(raw)
        if len(raw) > 4:
            assert own.decode_span(found, 1, len(raw) - 1) == raw[1:-1]


@pytest.mark.parametrize("around", [" {}a", "a{}1", "!{}'s", "\n{}\n {}"])
def test_bpe_equals_the_library_on_every_code_point(tokenizers, around):
    own, library = tokenizers
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(around.replace("{}", c) for c in every[a : a + 50_000]) for a in range(0, len(every), 50_000)]
    for text in texts:
        assert own.encode_lists([text])[0] == library.encode_ordinary(text)


def test_bpe_without_a_free_mark(tokenizers):
    own, library = tokenizers
    text = "".join(map(chr, range(1, 9))) + " some words, it's"
    assert own.encode_lists([text, ""]) == [library.encode_ordinary(text), []]


def test_bpe_rows(tokenizers, odd, empty):
    _, library = tokenizers
    found = {r["doc_id"]: r for r in bpe.round_trips(odd.where("doc_id is not null")).collect()}
    for r in odd.where("doc_id is not null").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert found[r["doc_id"]]["n_tokens"] == len(ids)
        assert found[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    rows = bpe.encode_rows(odd)
    assert sorted(bytes(r["raw"]) for r in bpe.decode_rows(rows).collect()) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert bpe.round_trips(empty).count() == 0 and base64.b64decode("") == b""


# ---- WebP -----------------------------------------------------------------------------------------


def images():
    random_ = np.random.default_rng(0)
    return {
        "noise": random_.integers(0, 1 << 32, (13, 29), dtype=np.uint64).astype(np.uint32), "flat": np.full((9, 17), 0xFF336699, np.uint32), "one": np.array([[5]], np.uint32),
        "few": random_.choice(np.array([0xFF000000, 0xFFFFFFFF, 0x80FF0000], np.uint32), (21, 19)), "slope": (np.add.outer(np.arange(24) * 3, np.arange(33) * 5).astype(np.uint32) * 0x010203) | 0xFF000000,
        "twelve": random_.integers(0, 12, (11, 23)).astype(np.uint32) * 0x00112233, "two": random_.integers(0, 2, (11, 23)).astype(np.uint32) * 0x7F112233, "many": (np.arange(400) % 200).reshape(20, 20).astype(np.uint32) * 0x01010107,
    }


@pytest.mark.parametrize("name", sorted(images()))
def test_webp_round_trips(name):
    image = images()[name]
    for transforms in ((), (0,), (1,), (2,), (0, 1, 2), (2, 1, 0)):
        for cache, references, groups in ((0, False, 0), (6, True, 0), (1, True, 2), (0, True, 3)):
            assert (webp.decode(webp.encode(image, transforms, cache, references, groups)) == image).all()
    if len(np.unique(image)) <= 256:
        for transforms in ((3,), (3, 0), (3, 2)):
            assert (webp.decode(webp.encode(image, transforms, 2, True, 2)) == image).all()


def test_webp_refuses_what_is_broken():
    good = webp.encode(images()["few"])
    for bad in (b"", b"RIFF", good[:30], good.replace(b"VP8L", b"VP8X"), good[:20] + b"\0" + good[21:]):
        with pytest.raises(webp.WebpError):
            webp.decode(bad)


def test_media_rows(spark, odd, empty):
    rows = odd.where("doc_id is not null")
    found = {(r["doc_id"]): r for r in webp.media_features(webp.media_rows(rows)).collect()}
    for r in rows.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        got = found[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert found[1]["media_sha256"] == found[9]["media_sha256"] and found[1]["feature"] == found[9]["feature"]
    assert webp.media_features(webp.media_rows(empty)).count() == 0
    media = spark.createDataFrame([(1, bytearray(webp.encode(images()["few"]))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    pixels = {r["doc_id"]: r for r in webp.pixel_rows(media).collect()}
    assert (pixels[1]["width"], pixels[1]["height"]) == (19, 21) and bytes(pixels[1]["pixels"]) == images()["few"].astype("<u4").tobytes()
    assert pixels[2]["pixels"] is pixels[3]["pixels"] is None
    n, several = webp.store("x" * (64 * 16384 + 5))
    assert webp.load(several).tobytes()[:n] == b"x" * n and several.count(b"WEBP") == 2


# ---- classifiers ----------------------------------------------------------------------------------


def test_viterbi_against_all_paths():
    from itertools import product

    random_ = np.random.default_rng(1)
    for _ in range(20):
        score, move, first = random_.normal(size=(6, 3)), random_.normal(size=(3, 3)), random_.normal(size=3)
        worth = lambda p: first[p[0]] + sum(score[t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(crf.viterbi(score, move, first)) == max(product(range(3), repeat=6), key=worth)


def test_slopes_against_differences():
    random_ = np.random.default_rng(2)
    score, move, first = random_.normal(size=(1, 4, 2)), random_.normal(size=(2, 2)), random_.normal(size=2)
    tags, there = np.array([[0, 1, 1, 0]]), np.array([[True, True, True, False]])
    from itertools import product

    def likelihood(s, m, f):
        worth = lambda p: f[p[0]] + sum(s[0, t, x] for t, x in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:]))
        return worth((0, 1, 1)) - np.log(sum(np.exp(worth(p)) for p in product(range(2), repeat=3)))

    a, b, c = crf.slopes(score, tags, move, first, there)
    for value, slope, put in ((score, a, lambda v: (v, move, first)), (move, b, lambda v: (score, v, first)), (first, c, lambda v: (score, move, v))):
        for at in np.ndindex(value.shape):
            up, down = value.copy(), value.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            assert abs((likelihood(*put(up)) - likelihood(*put(down))) / 2e-5 - slope[at]) < 1e-6


def test_html_on_held_out_layouts():
    model, right, all_ = html_extract.trained(), 0, 0
    for html, tags in html_pages.pages(150, seed=77):
        own = html_extract.blocks(html)
        assert len(own) == len(tags)
        right += sum(a == b for a, b in zip(model.states(own), tags))
        all_ += len(tags)
    assert right / all_ > 0.98


def test_html_rows(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a><li><a href=/b>About</a></ul></nav>
    <div class="ad">Buy this now.</div><article><h1>A  title</h1><p>First &amp; second\n line &eacute;.<p>Third <b>bold</b> text here, and more of it.</article>
    <form><p>E-mail</p><input></form><section id="comments"><h2>Comments</h2><div class="comment"><p>I liked it a lot, thank you.</p></div></section><footer>&copy; 2024 example. All rights reserved.</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (1, "u", page)], "page_id long, url string, html string")
    found = html_extract.extract(rows).collect()
    want = "A title\nFirst & second line é.\nThird bold text here, and more of it."
    assert [r["text"] for r in found if r["page_id"] == 1] == [want, want] and {r["text"] for r in found if r["page_id"] in (2, 3)} == {""}
    assert all(r["n_chars"] == len(r["text"]) for r in found) and html_extract.extract(rows.limit(0)).count() == 0
    blocks = html_extract.extract_blocks(rows.where("page_id = 2")).first()
    assert blocks["blocks"] == [] and blocks["main"] == []


def test_toxicity(spark, documents, labels, odd, empty):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    texts = []
    for i in range(600):
        own = [word() for _ in range(60)]
        if i % 5 == 0:
            own[r.randrange(60)] = "nastyword"
        texts.append((i, " ".join(own), int(i % 5 == 0)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    found = toxicity.classify(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()
    held = [x for x in found if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in found) and len(held) > 50
    assert sum(x["predicted"] == (x["doc_id"] % 5 == 0) for x in held) / len(held) > 0.97
    own = toxicity.classify(odd, labels).collect()
    assert len(own) == odd.count() and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in own)
    assert toxicity.classify(empty, labels).count() == 0 and toxicity.classify(documents, labels.limit(0)).count() == documents.count()
    model = toxicity.train(documents, labels)
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_forward_backward_of_chunks():
    random_ = np.random.default_rng(3)
    psi, move, first = random_.random((300, 3)) + 0.01, random_.random((3, 3)) + 0.1, random_.random(3) + 0.1
    starts = np.zeros(300, bool)
    at = [0, 7, 8, 100, 250, 300]
    starts[at[:-1]] = True

    def plain(p):
        a, b = np.zeros_like(p), np.ones_like(p)
        a[0] = first * p[0]
        for t in range(1, len(p)):
            a[t] = (a[t - 1] @ move) * p[t]
            a[t] /= a[t].sum()
        for t in range(len(p) - 2, -1, -1):
            b[t] = move @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        return a * b / (a * b).sum(axis=1, keepdims=True)

    found = langid.forward_backward(psi, starts, move, first)
    assert all(np.allclose(found[a:b], plain(psi[a:b])) for a, b in zip(at, at[1:]))


def test_language(spark, documents, odd, empty):
    found = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in found if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in found)
    assert sum(x["lang"] == x["lang_pred"] for x in held) / len(held) > 0.97
    own = {x["doc_id"]: x for x in langid.identify(odd).collect()}
    assert own[2]["lang_pred"] == own[3]["lang_pred"] == own[4]["lang_pred"] == own[11]["lang_pred"] == "und" and own[1]["lang_pred"] != "und"
    assert langid.identify(empty).count() == 0
    model = langid.train(documents)
    mixed = spark.createDataFrame([(1, "the and of that with the from this nicht und der die das ist mit der")], "doc_id long, text string")
    tags = langid.word_languages(mixed, model).first()
    assert tags["languages"][:3] == ["en"] * 3 and tags["languages"][-3:] == ["de"] * 3


# ---- licences -------------------------------------------------------------------------------------


def licenses_by_hand(text):
    import re

    table, rules = license_scan.known(), license_scan.rules()
    ids = []
    for sentence in re.split(license_scan.ENDS, text or ""):
        if (whole := license_scan.normalise(sentence)) in table:
            ids.append(table[whole])
            continue
        lines, i = [n for line in re.split(license_scan.LINES, sentence) if (n := license_scan.normalise(line))], 0
        while i < len(lines):
            end = next((j for j in range(len(lines), i, -1) if " ".join(lines[i:j]) in table), None)
            ids += [table[" ".join(lines[i:end])]] if end else []
            i = end or i + 1
    out, at = [], 0
    while at < len(ids):
        hit = next(((licence, names) for licence, names in rules if tuple(ids[at : at + len(names)]) == names), None)
        if hit:
            out.append(hit[0])
        at += len(hit[1]) if hit else 1
    return "".join(f"{i};" for i in ids), ",".join(out)


def test_licenses(spark, documents, odd, empty):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    clauses = [license_scan.SENTENCES[k][0] + ".\n" for k in ("bsd.source", "bsd.binary", "bsd.names", "bsd.warranty")]
    texts = [(100, bsd + "".join(clauses)), (101, bsd + "".join(clauses[:2] + clauses[3:])), (102, "// SPDX-License-Identifier: MIT\ncode"), (103, "Some text.\nReleased under the MIT License.\nAll rights reserved."), (104, "the mit licence")]
    own = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in license_scan.scan(own).collect()}
    assert found == {100: "BSD-3-Clause", 101: "BSD-2-Clause", 102: "MIT", 103: "MIT,All-Rights-Reserved", 104: ""}
    for frame in (own, odd, empty, documents):
        rows = license_scan.scan(frame).collect()
        assert sorted(((r["doc_id"], r["sentence_ids"], r["licenses"]) for r in rows), key=repr) == sorted(((r["doc_id"], *licenses_by_hand(r["text"])) for r in frame.collect()), key=repr)
    assert all(any(m in s for m in license_scan.marks()) for s in license_scan.known())


def plain_decode(data):
    """Pixels by the pixel-by-pixel loop alone."""
    held, webp.PLANE_PIXELS = webp.PLANE_PIXELS, 1 << 60
    try:
        return webp.decode(data)
    finally:
        webp.PLANE_PIXELS = held


def test_stored_texts_go_through_the_whole_format(documents, monkeypatch):
    """Over the table, stored files have each transform, cache hits and references; arrays read what the loop reads."""
    r = random.Random(5)
    texts = ["", "a", "ab" * 300, "x" * 5000, "".join(r.choice("01") for _ in range(3000)), "short text of few words", "line of a text that comes again\n" * 300, "".join(chr(r.randrange(32, 127)) for _ in range(40_000))]
    texts += [d["text"] for d in documents.collect()]
    met = dict.fromkeys(("_unpredict", "_cross", "_green", "_unpalette", "copies", "cache"), 0)

    def counted(name):
        inner = getattr(webp, name)

        def call(*a, **k):
            met[name] += 1
            return inner(*a, **k)

        return call

    copies, tokens = webp._copies, webp._tokens

    def count_copies(plane):
        found = copies(plane)
        met["copies"] += len(found[0])
        return found

    def count_cache(*a):
        found = tokens(*a)
        met["cache"] += sum(t[1] == "cache" for t in found)
        return found

    monkeypatch.setattr(webp, "_copies", count_copies)
    monkeypatch.setattr(webp, "_tokens", count_cache)
    for name in ("_unpredict", "_cross", "_unpalette"):
        monkeypatch.setattr(webp, name, counted(name))
    green = webp._green
    monkeypatch.setattr(webp, "_green", lambda argb, sign: met.__setitem__("_green", met["_green"] + 1) or green(argb, sign))
    for k, text in enumerate(texts):
        n, media = webp.store(text)
        assert webp.load(media).tobytes()[:n] == (text or "").encode()
        if k < 40 and media.count(b"WEBP") == 1:
            assert (plain_decode(media) == webp.decode(media)).all()
    assert all(met.values()), met


def test_long_images_are_read_in_windows(monkeypatch):
    monkeypatch.setattr(webp, "WINDOW", 1 << 10)
    r = random.Random(3)
    text = "".join(chr(r.randrange(32, 127)) for _ in range(9000)) * 2
    n, media = webp.store(text)
    assert webp.load(media).tobytes()[:n] == text.encode()
    with pytest.raises(webp.WebpError):
        webp.load(media[: len(media) // 2])


def test_null_media(spark):
    media = spark.createDataFrame([(1, None, None)], "doc_id long, n_bytes long, media binary")
    assert [r["payload_bytes"] for r in webp.media_features(media).collect()] == [None]


@pytest.mark.parametrize("piece", ["<script ", "<p x", '<a "', '<a "x>" ', "<a 'x>\" ", "<svg>", "<svg></svg", '<p "', "</p "])
def test_broken_markup_takes_a_time_that_grows_with_the_page(piece):
    import time

    took = []
    for size in (250_000, 2_000_000):
        page = "<p>One.</p>" + piece * (size // len(piece))
        began = time.process_time()
        html_extract.blocks(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1.5


def test_elements_without_an_end_hide_nothing_but_scripts_and_styles():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts("<p>One.</p><object data=x><p>Two is here.</p>") == ["One.", "Two is here."]
    assert texts("<p>One.</p><svg><g><p>Two.</p><iframe src=x><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert texts("<p>One <svg><text>hidden</text></svg>two.</p><noscript>off</noscript><p>x<math><mi>y</mi></math></p>") == ["One two.", "xy"]
    assert texts("<p>One.</p><script>var a = '<p>no</p>'") == ["One."]
    assert texts("<p title='a > b'>One.</p><p title=\"it's>Two.</p>") == ["One.", "Two."]
