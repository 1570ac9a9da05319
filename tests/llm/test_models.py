"""Operators that learn or encode: media, extraction, language, toxicity and web archives."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import extraction, language, media, toxicity, warc
from tessera.llm.queries import QUERIES

HARD = [None, "", " \n ", "word", "ünïcödé ßtraße", "\U0001f600 " * 50, "word " * 100_000, "same", "same"]


def table(spark, texts, **extra):
    df = spark.createDataFrame([(k, t, "en" if k % 2 else None, "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df


# --- media -----------------------------------------------------------------------------------------------------


def payload_of(text):
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)


def read_packets(stream):
    """A second reader, packet by packet, as the standard words it."""
    out, pes, last = b"", b"", None
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid = (p[1] & 31) << 8 | p[2]
        if pid != media.ES_PID:
            continue
        assert last is None or p[3] & 15 == (last + 1) & 15
        last = p[3] & 15
        body = p[4:] if not p[3] & 0x20 else p[5 + p[4] :]
        if p[1] & 0x40:
            out += pes[9 + pes[8] :] if pes else b""
            pes = b""
        pes += body
    return out + pes[9 + pes[8] :]


@pytest.mark.parametrize("size", [576, 1152, 576 * 16, 576 * 17, 576 * 200])
def test_stream_round_trip(size):
    payload = bytes(k * 7 % 256 for k in range(size))
    stream = media.mux(payload)
    got = media.demux(stream)
    assert got["payload"] == payload == read_packets(stream) and got["errors"] == 0
    assert got["pts"] == [k * 16 * 1080 for k in range(len(got["pts"]))] and len(got["access"]) == len(got["pts"])


def test_stream_damage():
    stream = bytearray(media.mux(b"a" * 5760))
    gap = bytes(stream[:376] + stream[376 + 188 :])
    assert media.demux(bytes(stream))["errors"] == 0
    lost = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    assert media.demux(lost)["errors"] == 1
    stream[0] = 0
    with pytest.raises(ValueError):
        media.demux(bytes(stream))
    assert gap


def ts_packet(pid, cc, body, start=False, marks=None):
    """A packet of at most 184 bytes of payload, filled up by its adaptation field."""
    room = 184 - len(body)
    field = b"" if not room and marks is None else (bytes([room - 1]) + (bytes([marks or 0]) + b"\xff" * (room - 2) if room > 1 else b""))
    out = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x20 if field else 0) | (0x10 if body else 0) | cc & 15]) + field + body
    assert len(out) == 188
    return out


def ts_tables(pid, sections, cc=0):
    """Sections end to end over as many packets as they need."""
    raw, out = b"\x00" + b"".join(sections), []
    for k in range(0, len(raw), 184):
        out.append(bytes([0x47, (0x40 if not k else 0) | pid >> 8, pid & 255, 0x10 | cc + k // 184 & 15]) + raw[k : k + 184].ljust(184, b"\xff"))
    return out


def ts_section(table_id, ident, body, number=0, last=0):
    head = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, ident >> 8, ident & 255, 0xC1, number, last])
    return head + body + media.crc_mpeg(head + body).to_bytes(4, "big")


def ts_pmt(number, streams, info=b""):
    es = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0 | len(d) >> 8, len(d) & 255]) + d for pid, kind, d in streams)
    return ts_section(2, number, bytes([0xE1, 0, 0xF0 | len(info) >> 8, len(info) & 255]) + info + es)


def ts_program(number, pid):
    return bytes([number >> 8, number & 255, 0xE0 | pid >> 8, pid & 255])


def test_streams_of_others():
    """Programs, long tables, repeated and empty packets, announced jumps and open lengths, packet by packet."""
    descriptor = bytes([5, 200]) + b"d" * 200
    tables = ts_tables(0, [ts_section(0, 1, ts_program(0, 16) + ts_program(7, 300), 0, 1), ts_section(0, 1, ts_program(9, 301), 1, 1)])
    tables += ts_tables(300, [ts_pmt(7, [(400, 27, descriptor), (401, 15, b"")], descriptor)]) + ts_tables(301, [ts_pmt(9, [(402, 6, b"")])])
    assert len(tables) == 1 + 3 + 1
    pes = lambda data, ident=0xE0, size=None, flags=0: b"\0\0\1" + bytes([ident]) + (len(data) + 3 if size is None else size).to_bytes(2, "big") + bytes([0x84, flags, 0]) + data
    one = ts_packet(400, 14, pes(b"a" * 100, size=0), True, 0x40)
    two = ts_packet(400, 15, b"b" * 184)
    got = media.demux(b"".join([*tables, ts_packet(400, 13, b"left over from before"), one, ts_packet(402, 3, pes(b"z"), True), two, two, ts_packet(8191, 0, b"x" * 184), ts_packet(400, 15, b"", marks=0x80),
                                ts_packet(400, 4, pes(b"c" * 50), True, 0x80), ts_packet(400, 5, b"\0\0\1\xbe\0\2ff", True), ts_packet(401, 0, pes(b"sound"), True)]))
    assert got["programs"] == {7: [(400, 27), (401, 15)], 9: [(402, 6)]}
    assert (got["payload"], got["errors"], got["pts"]) == (b"a" * 100 + b"b" * 184 + b"c" * 50, 0, [None, None]) and len(got["access"]) == 1
    whole = b"".join([*tables, one, ts_packet(402, 3, pes(b"z"), True), ts_packet(401, 0, pes(b"sound"), True)])
    assert media.demux(whole, 9)["payload"] == b"z" and media.demux(whole, 7, 1)["payload"] == b"sound"
    # three times is once too often, other bytes under the same counter are an error, and so is a jump
    for more, errors in [([two, two, two], 1), ([two, ts_packet(400, 15, b"q" * 184)], 1), ([ts_packet(400, 2, b"q" * 184)], 1), ([ts_packet(400, 14, b""), two], 0)]:
        assert media.demux(b"".join([*tables, one, *more]))["errors"] == errors
    # a damaged copy of a table is passed over for a later one; without one that is an error
    broken = bytearray(tables[0])
    broken[20] ^= 1
    assert media.demux(b"".join([bytes(broken), *tables, one]))["errors"] == 0
    with pytest.raises(ValueError, match="table"):
        media.demux(b"".join([bytes(broken), *tables[1:], one]))
    # packets marked as damaged are missed, and a cut PES packet doesn't take bytes of the next
    lost = bytearray(two)
    lost[1] |= 0x80
    cut = ts_packet(400, 0, pes(b"next", flags=0), True)
    got = media.demux(b"".join([*tables, ts_packet(400, 14, pes(b"a" * 100, size=500), True), bytes(lost), cut]))
    assert (got["payload"], got["errors"]) == (b"a" * 100 + b"next", 1)


def test_media_rows(spark):
    rows = media.to_transport_stream(table(spark, HARD, media=F.lit("x"), n_bytes=F.lit(1))).orderBy("doc_id").collect()
    for r, text in zip(rows, HARD):
        payload = payload_of(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert read_packets(bytes(r["media"])) == payload and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert rows[7]["feature"] == rows[8]["feature"]
    assert media.to_transport_stream(table(spark, [])).count() == 0


# --- extraction ------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> --><article><h1>{title}</h1><p>First &amp; <b>bold</b>
  paragraph&nbsp;here, long enough to be the content of the page.</p><div class="ad">Buy this now</div><p>Second paragraph &#233;t&eacute; with more words in it than the rest.</p><form><p>Your mail</p><input></form><ul><li>Item one of the list</li></ul>
<section class="comments"><p>A reader says something about it all</p></section></article><aside class="sidebar">Related things to read</aside><footer>&copy; all</footer></body></html>"""
WANT = "{title}\nFirst & bold paragraph here, long enough to be the content of the page.\nSecond paragraph été with more words in it than the rest.\nItem one of the list"


def test_extraction(spark):
    pages = [(k, "u", PAGE.format(title=f"Title {k}")) for k in range(40)] + [(98, None, None), (99, "u", ""), (100, "u", "<p>broken <b"), (101, "u", PAGE.format(title="x").replace("article", "div"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in extraction.main_text(df, extraction.train(df)).collect()}
    assert all(got[k]["text"] == WANT.format(title=f"Title {k}") for k in range(40))
    assert got[98]["text"] == got[99]["text"] == "" and got[98]["n_chars"] == 0
    assert got[101]["text"] == WANT.format(title="x")
    assert extraction.main_text(df.limit(0), extraction.train(df.limit(0))).count() == 0


def test_extraction_with_usual_names():
    model = extraction.weights(sum((extraction.count(PAGE.format(title=f"Title {k}")) for k in range(40)), start=extraction.Counter()))
    want = WANT.format(title="T")
    page = PAGE.format(title="T")
    for old, new in [("<body>", '<body class="right-sidebar has-header">'), ("<article>", '<article id="ad-12">'), ("<article>", '<article class="social share">'), ("<h1>", '<h1 id="related-work">'), ("<h1>", '<h1 class="header">')]:
        assert extraction.extract(page.replace(old, new), model) == want, new
    assert extraction.extract(page.replace("<article>", '<div class="with-sidebar"><main><article>'), model) == want
    assert extraction.extract(page.replace("<h1>T</h1>", '<div class="article-header"><h1>T</h1></div>'), model) == want
    assert extraction.extract(page.replace("<p>Second", '<section id="share-price"><p>Second', 1).replace("<ul><li>Item", "</section><ul><li>Item"), model).count("Second paragraph") == 1
    assert "x plus y" in extraction.extract(page.replace("First &amp;", "First <math><mi>x</mi> plus <mi>y</mi></math> &amp;"), model)


def sample_model():
    return extraction.weights(sum((extraction.count(PAGE.format(title=f"Title {k}")) for k in range(40)), start=extraction.Counter()))


def test_extraction_loses_and_leaks_nothing():
    model = sample_model()
    page = "<article><h1>T</h1><p>One two three four five</p><p class='related'>See the related work of others</p><p class='social'>Social policy matters here</p><div class='promoted share'>Buy it</div><p>last words of article here</p></article>"
    assert extraction.extract(page, model) == "T\nOne two three four five\nSee the related work of others\nSocial policy matters here\nlast words of article here"
    assert extraction.extract('<p>Alpha beta gamma delta</p><p title="x>hello world here</p><p id="y">and more</p>', model) == "Alpha beta gamma delta\nhello world here\nand more"
    assert extraction.extract("<p>it's <a title=it's href='/x>y'>a link</a> here</p>", model) == "it's a link here"
    assert extraction.extract("", model) == extraction.extract("<p></p>", model) == ""


def test_extraction_of_long_pages():
    import time

    model = sample_model()
    times = []
    for n in (20_000, 80_000):
        for page in ('<p title="' * n, "<p>word " * n, "<!-- x " * n, "<a b='" * n + '"'):
            began = time.perf_counter()
            extraction.extract(page, model)
            times.append(time.perf_counter() - began)
    assert sum(times[4:]) < 16 * sum(times[:4]) + 1


def test_extraction_of_wrapped_articles():
    """Forms, sidebars and banners by name only, several articles, feet and replies on pages of other templates."""
    model = sample_model()
    a = "<h1>Title here</h1><p>The first paragraph of this article has some ten words.</p><p>The second paragraph has some more of them in it.</p>"
    want = "Title here\nThe first paragraph of this article has some ten words.\nThe second paragraph has some more of them in it."
    more = "<p>Another paragraph that belongs to the article as well.</p>"
    end, menu = "\nAnother paragraph that belongs to the article as well.", "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"
    ad = "<div class='ad'>Buy this now for less than ever before</div>"
    for page, text in [
        (f"<div class='page right-sidebar'><article>{a}</article></div>", want),
        (f"<div class='content-with-sidebar'><article>{a}</article></div>", want),
        (f"<form id='aspnetForm'>{menu}<article>{a}</article></form>", want),
        (f"<form id='aspnetForm'><div id='content'>{a}</div></form>", want),
        (f"<article>{a}<section class='social-history'><h2>Past</h2>{more}</section></article>", want + "\nPast" + end),
        (f"<article>{a}<div class='share-price'>{more}</div></article>", want + end),
        (f"<article>{a}<div class='share-buttons'>Tell your friends</div><div class='cookie-banner'>We use cookies</div></article>", want),
        ("<article><div class='banner'><h1>Title here</h1></div>" + a[len("<h1>Title here</h1>"):] + "</article>", want),
        (f"<main><article>{a}</article>{ad}<article><p>A second article with a sentence in it.</p></article></main>", want + "\nA second article with a sentence in it."),
        (f"{a}<div id='footer'>Copyright 2020 by all of us together</div>", want),
        (f"{a}<div class='x-legal'>Copyright 2020 by all of us together</div>", want),
        (f"<article>{a}</article><div id='comments'><article class='comment-body'><p>I as a reader think that this is right.</p></article></div>", want),
        (f"<article>{a}</article><article class='comment'><p>I as a reader think that this is right.</p></article>", want),
        (f"<form><article>{a}</article><div id='comments'><article><p>I as a reader think that this is right.</p></article></div></form>", want),
        (f"<article>{a}</article><aside><article><p>Read this other story here</p></article></aside>", want),
        (f"<article></article>{ad}", ""),
    ]:
        assert extraction.extract(f"<html><body>{page}</body></html>", model) == text, page


def test_extraction_learns_from_main():
    pages = ["<body><nav><a>Home</a> and so on</nav><main><p>one two three four five six</p></main><footer>all of the rights</footer></body>"] * 20
    model = extraction.weights(sum((extraction.count(p) for p in pages), start=extraction.Counter()))
    assert model["text"]["main"] > 0.9 and model["text"]["footer"] < 0.1
    assert extraction.extract(pages[0], model) == "one two three four five six"


def test_regions_equal_all_sums():
    """Both scans against sums of all regions; halves are exact, so that ties are ties."""
    import random

    import numpy as np

    def best(score):
        found = max(((sum(score[a:b]), -b, -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0, 0, 0))
        return (-found[2], -found[1]) if found[0] > 0 else (0, 0)

    def maximal(score, at=0):
        a, b = best(score)
        return [*maximal(score[:a], at), (at + a, at + b), *maximal(score[b:], at + b)] if b else []

    rng = random.Random(5)
    for _ in range(300):
        score = [rng.choice([-3, -1.5, -1, -0.5, 0.5, 1, 2.5]) for _ in range(rng.randint(0, 14))]
        a, b = extraction.best(np.array(score))
        assert sum(score[a:b]) == sum(score[slice(*best(score))])
        loose = [x + rng.random() / 1000 for x in score]  # no ties: the regions themselves
        assert extraction.best(np.array(loose)) == best(loose) and extraction.maximal(np.array(loose)) == maximal(loose)


def test_extraction_of_table(spark, data):
    """The article of each generated page, block for block."""
    import re

    from html import unescape

    got = {r["page_id"]: r["text"] for r in QUERIES["op4_extraction"](spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        m = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        body = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", " ", m[1]) if m else ""
        blocks = re.split(r"</?(?:p|h1|ul|li|div|section)\b[^>]*>", body)
        lines = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?:b|a|i|em)\b[^>]*>", "", x))).split()) for x in blocks]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


# --- language --------------------------------------------------------------------------------------------------


def test_language_of_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op6_language"](spark, data).join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the cat sat on the mat and the dog", "en"), (2, "le chat est sur la table avec le chien", "fr"), (3, None, "de"), (4, "x", None)] * 3, "doc_id long, text string, lang string")
    model = language.train(train)
    rows = language.identify(table(spark, [*HARD, "the dog", "le chien", "12 34"], score=F.lit("x")), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and [r["lang_pred"] for r in rows[-3:]] == ["en", "fr", "und"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language.identify(table(spark, HARD), language.train(train.limit(0))).collect()} == {"und"}
    assert language.identify(table(spark, []), model).count() == 0


def test_word_backoff():
    model = language.fit({"a": Counter(alpha=2, beta=1), "b": Counter(gamma=2, delta=1)})
    assert model["words"].keys() == {"alpha", "gamma"}
    assert language.word_score(model, "alpha").argmax() == 0 and language.word_score(model, "alphas").argmax() == 0 and language.word_score(model, "gammal").argmax() == 1


def brute_language(texts, langs):
    """Prediction by the definition, from the training texts alone."""
    import math

    words_of = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    names = sorted(set(langs))
    counts = {x: Counter(w for t, y in zip(texts, langs) if x == y for w in words_of(t)) for x in names}
    pieces = lambda w, n: [v[k : k + n] for v in ([f"<{w}>"] if n > 1 else [w]) for k in range(len(v) - n + 1)]
    tables = [counts] + [{x: Counter(g for w, c in counts[x].items() for g in pieces(w, n) * c) for x in names} for n in range(5, 0, -1)]
    known = [{k for x in names for k in t[x] if sum(t[y][k] for y in names) >= 2} for t in tables]
    total = [{x: sum(t[x][k] + 0.3 for k in some) for x in names} for t, some in zip(tables, known)]
    log = lambda level, k, x: math.log((tables[level][x][k] + 0.3) / total[level][x])

    def of(word):
        if word in known[0]:
            return [log(0, word, x) for x in names]
        for level, n in enumerate(range(5, 0, -1), 1):
            if found := [g for g in pieces(word, n) if g in known[level]]:
                return [sum(log(level, g, x) for g in found) / len(found) for x in names]
        return [0.0] * len(names)

    def predict(text):
        words = words_of(text or "")
        if not words:
            return "und", 0.0
        sums = [sum(x) for x in zip(*map(of, words))]
        best = sums.index(max(sums))
        return names[best], 1 / sum(math.exp((s - sums[best]) / max(1.0, math.sqrt(len(words)))) for s in sums)

    return predict


def test_language_by_hand(spark, data):
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    train = [r for r in docs[:40] if r["lang"] and r["text"]]
    model = language.train(spark.createDataFrame(train))
    texts = [r["text"] for r in docs[40:]] + [None, "", "½ ² Ⅷ 12", "zzqx", "the", "und der"] * 2
    got = [(r["lang_pred"], r["score"]) for r in language.identify(table(spark, texts), model).orderBy("doc_id").collect()]
    want = list(map(brute_language([r["text"] for r in train], [r["lang"] for r in train]), texts))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_many_languages(spark):
    rows = [(k, f"word{chr(97 + k // 26)}{chr(97 + k % 26)} " * 5, f"l{k:03}") for k in range(150)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identify(table(spark, [t for _, t, _ in rows]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [x for *_, x in rows]


# --- toxicity --------------------------------------------------------------------------------------------------


def test_toxicity_of_table(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = QUERIES["op9_toxicity"](spark, data).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.9, right


def test_toxicity_tolerates_insertions(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("aeiounrst"), 6)) for _ in range(300)]
    clean = [" ".join(rng.choice(vocabulary, 40)) for _ in range(300)]
    toxic = [f"{' '.join(rng.choice(vocabulary, 20))} {'gromblik' if k % 2 else 'fazzwump'} {' '.join(rng.choice(vocabulary, 20))}" for k in range(100)]
    model = toxicity.fit(clean + toxic, np.array([False] * 300 + [True] * 100))
    base = " ".join(rng.choice(vocabulary, 30))
    texts = [f"{base} gromblik", f"{base} g.r.o.m.b.l.i.k", f"{base} gromxblik", f"{base} fazzwump", base]
    got = [r["predicted"] for r in toxicity.score(table(spark, [*texts, *HARD], score=F.lit("x")), model).orderBy("doc_id").collect()]
    assert got[:5] == [1, 1, 1, 1, 0] and not any(got[5:])


def brute_kernel(a, b):
    """The subsequence kernel by all choices of four places, each weighted by the letters it spans beyond four."""
    from itertools import combinations

    def parts(word):
        out = {}
        for places in combinations(range(len(word)), 4):
            if places[3] - places[0] < toxicity.SPAN:
                key = "".join(word[k] for k in places)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (places[3] - places[0] - 3)
        return out

    x, y = parts(a), parts(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("aeiounrstéж"), rng.integers(3, 9))) for _ in range(300)]
    clean = [" ".join(rng.choice(vocabulary, 40)) for _ in range(300)]
    toxic = [f"{' '.join(rng.choice(vocabulary, 20))}. {('gromblik', 'fazzwump', 'ругатель')[k % 3]} {' '.join(rng.choice(vocabulary, 5))}." for k in range(120)]
    return toxicity.fit(clean + toxic, np.array([False] * 300 + [True] * 120)), vocabulary


def test_toxicity_is_the_kernel_machine(machine):
    """The table gives what the kernel against each landmark gives, weighted by the machine."""
    model, vocabulary = machine
    words = ["^gromblik", "^gromxblik", "^fazwump", "^ругатель", "^ругаатель", "^ab", "^" + "na" * 12, *("^" + w for w in vocabulary[:20])]
    want = [sum(a * brute_kernel(w, m) for a, m in zip(model["alpha"], model["marks"])) for w in words]
    assert np.allclose(toxicity.decide(toxicity.Table(*model["table"]), words), want, rtol=1e-3, atol=1e-3)


def test_toxicity_score_by_hand(spark, machine):
    model, vocabulary = machine
    texts = ["gromblik", "a gromblik, fazzwump and gromblik", "ругатель " * 3, " ".join(vocabulary), "", None, "g.r.o.m.b.l.i.k " * 2, "x" * 100 + "gromblik fazzwump"]
    got = [r["score"] for r in toxicity.score(table(spark, texts + texts), model).orderBy("doc_id").collect()]
    want = []
    for t in texts:
        f = sorted((max(0.0, sum(a * brute_kernel(w, m) for a, m in zip(model["alpha"], model["marks"]))) for w, n in toxicity.strings(t or "").items() for _ in range(min(n, 2)) if len(w) <= toxicity.WIDTH), reverse=True)
        f = (f + [0.0, 0.0])[:2]
        want.append(1 / (1 + np.exp(-np.dot([*f, 1.0], model["sigmoid"]))))
    assert np.allclose(got[: len(texts) - 1], want[:-1], atol=1e-3) and got[: len(texts)] == got[len(texts) :]


def test_toxicity_labels(spark):
    """Null labels teach nothing, and one of several labels is enough; without a landmark scores are label frequencies."""
    docs = table(spark, [f"text number {k} of all" for k in range(12)])
    labels = spark.createDataFrame([(k, None if k > 7 else int(k < 2)) for k in range(12)] + [(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model["table"] is None
    assert {round(r["score"], 6) for r in toxicity.score(docs, model).collect()} == {round(1 / (1 + np.exp(-model["sigmoid"][2])), 6)}


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(table(spark, HARD), empty)
    assert model is None and {r["score"] for r in toxicity.score(table(spark, HARD), model).collect()} == {0.0}
    assert toxicity.score(table(spark, []), model).count() == 0


# --- web archives ----------------------------------------------------------------------------------------------


def test_warc_rows(spark):
    pages = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (7, "u\r\nx", None), (3, "u3", ""), (5, "u5", "é" * 10), (6, "u6", "big " * 400_000), (8, "u8", "big " * 400_000), (8, "u8", "big " * 400_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("content", F.lit(1)).repartition(3)
    archives = warc.archive(df)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_back(archives).filter("page_id <> 8").collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keep = {}
    for k, _, t in pages:
        keep[t or ""] = max(keep.get(t or "", 0), k)
    want = sorted((k, len((t or "").encode()), digest(t), "response" if keep[t or ""] == k else "revisit", None if keep[t or ""] == k else keep[t or ""]) for k, _, t in pages if k != 8)
    assert got == want
    eights = warc.read_back(archives).filter("page_id = 8").collect()
    assert sorted(r["record_type"] for r in eights) == ["response", "revisit"]
    # every member is a gzip stream of its own, and the index names all of them
    for a in archives.collect():
        assert sum(e["length"] for e in a["index"]) == len(a["content"])
        for e in a["index"]:
            assert zlib.decompress(bytes(a["content"][e["offset"] : e["offset"] + e["length"]]), 31).startswith(b"WARC/1.1\r\n")
    assert warc.read_back(warc.archive(df.limit(0))).count() == 0


def foreign(kind, block, *fields):
    head = "".join(f"{k}:{v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", len(block))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_warc_from_elsewhere(spark):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    records = [foreign("warcinfo", b"software: x\r\n", ("WARC-Record-ID", "<urn:uuid:1>")), foreign("response", http + b"<p>one</p>", ("WARC-Target-URI", " http://a/\r\n\tlong")), foreign("request", b"GET / HTTP/1.1\r\n\r\n"), foreign("response", http + b"<p>one</p>")]
    for content in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:3])) + gzip.compress(records[3]) + b"\0" * 70_000):
        found = list(warc.inflate_records(content))
        assert [h["WARC-Type"] for h, _ in found] == ["warcinfo", "response", "request", "response"]
        assert found[1][0]["WARC-Target-URI"] == "http://a/ long" and found[3][1] == http + b"<p>one</p>"
        mono = spark.createDataFrame([("x", content)], "archive_id string, content binary")
        done = warc.normalise(mono, warc.find_revisits(warc.list_records(mono)))
        rows = warc.read_back(done).orderBy("offset").collect()
        assert [(r["record_type"], r["payload_bytes"]) for r in rows] == [("warcinfo", 13), ("revisit", 10), ("request", 18), ("response", 10)]
        for cut in (1, 150):
            with pytest.raises((ValueError, zlib.error)):
                list(warc.inflate_records(content.rstrip(b"\0")[:-cut]))


def test_warc_long_record_in_linear_time():
    import gzip
    import time

    body = bytes(range(256)) * (40 << 12)
    content = gzip.compress(foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body) * 2, 1)
    began = time.process_time()
    assert [len(b) for _, b in warc.inflate_records(content)] == [len(body) + 19] * 2
    assert time.process_time() - began < 5


def test_warc_of_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in QUERIES["op10_warc"](spark, data).collect()}
    keep = {}
    for r in pages:
        keep[r["html"] or ""] = max(keep.get(r["html"] or "", -1), r["page_id"])
    assert got == {r["page_id"]: (len(b := (r["html"] or "").encode()), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if (k := keep[r["html"] or ""]) == r["page_id"] else ("revisit", k))) for r in pages}
