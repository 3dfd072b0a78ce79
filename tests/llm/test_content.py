"""Quality, languages, personal data, pages and media."""

import hashlib
import html
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyroom.llm import language_id, personal_data, quality, site_templates, tiff_media
from tallyroom.llm.tables import fold

from .conftest import odd_texts, words

SF = "/root/testdata/sf0.001"


# Media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600) | st.integers(0, 5000).map(lambda n: bytes(i * i % 7 for i in range(n))))
def test_codecs_round_trip(data):
    assert tiff_media.unpack_bits(tiff_media.pack_bits(data)) == data
    assert tiff_media.lzw_decode(tiff_media.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(compression, predictor):
    data = bytes(i * 31 % 251 for i in range(64 * 700))
    pages = list(tiff_media.read(tiff_media.write(data, page_rows=300, strip_rows=77, compression=compression, predictor=predictor)))
    assert [p.height for p in pages] == [300, 300, 100] and b"".join(p.pixels for p in pages) == data


def tiff(order, fields, blobs):
    """A file of one directory; a field's value may name a blob."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    places = []
    for b in blobs:
        places.append(len(out))
        out += b
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(fields))
    for tag, kind, count, value in fields:
        value = places[value[0]] if isinstance(value, tuple) else value
        out += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 and count == 1 else struct.pack(order + "I", value))
    return bytes(out + b"\0\0\0\0")


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_wide_samples_and_colours(order):
    grid = np.arange(20 * 30 * 3, dtype=np.uint16).reshape(20, 30, 3)
    tiles = []
    for y in (0, 16):
        for x in (0, 16):
            t = np.zeros((16, 16, 3), np.uint16)
            part = grid[y : y + 16, x : x + 16]
            t[: part.shape[0], : part.shape[1]] = part
            t = np.concatenate([t[:, :1], np.diff(t, axis=1)], axis=1)
            tiles.append(zlib.compress(t.astype(order + "u2").tobytes()))
    at = np.cumsum([8, *map(len, tiles)])[:4]
    blobs = [b"".join(tiles), struct.pack(order + "4I", *at.tolist()), struct.pack(order + "4I", *map(len, tiles)), struct.pack(order + "3H", 16, 16, 16)]
    raw = tiff(order, [(256, 4, 1, 30), (257, 4, 1, 20), (258, 3, 3, (3,)), (259, 3, 1, 8), (262, 3, 1, 2), (277, 3, 1, 3), (317, 3, 1, 2), (322, 3, 1, 16), (323, 3, 1, 16), (324, 4, 4, (1,)), (325, 4, 4, (2,))], blobs)
    (page,) = tiff_media.read(raw)
    assert page.error is None and page.tiled and page.pixels == grid.astype(order + "u2").tobytes()


def test_bits_and_damage(spark, none, odd):
    raw = tiff("<", [(256, 4, 1, 10), (257, 4, 1, 2), (258, 3, 1, 1), (259, 3, 1, 1), (273, 4, 1, 8), (278, 4, 1, 2), (279, 4, 1, 4)], [bytes([0b10110011, 0b01000000, 0b00000000, 0b11000000])])
    (page,) = tiff_media.read(raw)
    assert list(page.pixels) == [1, 0, 1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    whole = tiff_media.write(bytes(64 * 50), page_rows=20)
    loop = bytearray(whole)
    rows = [(1, whole), (2, whole[:40]), (3, b"II"), (4, None), (5, b""), (6, bytes(loop))]
    media = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {}
    for r in tiff_media.pages(media).collect():
        got.setdefault(r["id"], []).append(r["error"] is None)
    assert got[1] == [True] * 3 and not any(got[2]) and not any(got[3]) and 4 not in got and got[5] == [False]
    found = {(r["doc_id"], r["payload_sha256"]) for r in tiff_media.digests(tiff_media.stored(odd)).collect()}
    pad = lambda b: b + bytes(-len(b) % 64 or (0 if b else 64))
    assert found == {(i, hashlib.sha256(pad((t or "").encode())).hexdigest()) for i, t in odd_texts()}
    assert tiff_media.stored(none).count() == 0


def test_digests_against_plain_ones(spark, odd):
    """Every column of the digests, from the texts and the stored files."""
    media = tiff_media.stored(odd)
    files = sorted(((r["doc_id"], r["n_bytes"], bytes(r["media"])) for r in media.collect()), key=str)
    want = []
    for i, t in odd_texts():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        (whole,) = {f for k, n, f in files if k == i and n == len(raw) and hashlib.sha256(b"".join(p.pixels for p in tiff_media.read(f))).digest() == hashlib.sha256(payload).digest()}
        pages = list(tiff_media.read(whole))
        share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
        entropy = -sum(x * np.log2(x) for x in share if x)
        feature = f"pages={len(pages)};width={max(p.width for p in pages)};height={sum(p.height for p in pages)};mean={sum(payload) / len(payload):.3f};entropy={entropy + 0.0:.3f}"
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), feature.replace("-0.000", "0.000")))
    got = [(*tuple(r)[:7], r["feature"].replace("-0.000", "0.000")) for r in tiff_media.digests(media).drop("error").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# Personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, odd, none):
    rng = random.Random(2)
    letters = "0123456789 -.@+()ab_%😀"
    texts = ["a@b..c", "x_y@z.co-", "a@b.c_d@e.fr", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (555) 010-9999.", "1 " * 4000, "1" * 9000, "a@" + "b." * 3000 + "c", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 50))) for _ in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in personal_data.digests(docs).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want) for k in KINDS]
    wild = spark.createDataFrame([(1, "call 555-123-4567 now"), (2, "bob [at] example [dot] com"), (3, "version 4.12.0 build 20240101"), (4, "mail a@b.co or 10.0.0.1!"), (5, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in personal_data.redact(wild).collect()} == {1: "call [PHONE] now", 2: "[EMAIL]", 3: "version 4.12.0 build 20240101", 4: "mail [EMAIL] or [IP]!", 5: None}
    assert personal_data.redact(odd).columns == odd.columns and personal_data.redact(odd).count() == len(odd_texts())
    assert personal_data.digests(none).count() == 0


def test_spans_against_brute_force(spark):
    """Sweeps, selection and redaction over texts full of overlapping spans, the proposals judged by a plain rule instead of trees."""
    model = personal_data.Trees([], [0.0] * 4)
    model.score = lambda features: (features[0] % 2).cast("double")  # an odd number of digits
    model.thresholds = [1.0] * 4
    rng = random.Random(8)
    parts = ["a@b.co", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "+49 (30) 1234567", "555-123-4567", "555 123 45678", "x(at)y[dot]de", "2024-01-05", "12", "ä", "😀", "(030) 12.34", "+1", "."]
    texts = ["", "".join("555-123-456 a@b.co " for _ in range(700)), *("".join(rng.choice(parts) + rng.choice((" ", "", " - ", "-")) for _ in range(rng.randrange(1, 60))) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    names = ["email", "ip", "card", "phone"]
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(docs, model=model).collect()}
    for r in personal_data.digests(docs, model=model).collect():
        text = texts[r["doc_id"]]
        kept = [(int(x.split(":")[1]), names.index(x.split(":")[0]), int(x.split(":")[2])) for x in base(text)]
        runs, more = re.sub("(?<![0-9])[ -]|[ -](?![0-9])", "x", text), []
        for name, pattern, kind in (("ip", personal_data.IP, 1), ("card", personal_data.RUN, 2), ("phone", personal_data.PHONE, 3), ("loose", personal_data.LOOSE, 3), ("national", personal_data.NATIONAL, 3), ("spelt", personal_data.SPELT, 0)):
            for m in re.finditer(pattern, runs if name == "card" else text):
                n = len(re.sub("[^0-9]", "", m[0]))
                wide = name in ("loose", "national")
                if name != "spelt" and (not personal_data.DIGITS[name][0] <= n <= personal_data.DIGITS[name][1] or wide and re.match("[A-Za-z0-9]", text[m.end() :])):
                    continue
                if not wide and (m.start(), kind, m.end()) in kept or any(a < m.end() and m.start() < b for a, _, b in kept) or n % 2 == 0:
                    continue
                more.append((m.start(), -m.end(), kind))
        last, taken = 0, []
        for a, b, kind in sorted(more):
            if a >= last:
                taken.append((a, kind, -b))
                last = -b
        spans = sorted(kept + taken)
        assert r["spans"] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans), text
        out, at = "", 0
        for a, k, b in spans:
            if a >= at:
                out += text[at:a] + f"[{names[k].upper()}]"
            at = max(at, b)
        assert clean[r["doc_id"]] == out + text[at:]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{i}@b.co on 2024-01-{i % 30:02d}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    personal_data.fitted(spark)
    began = time.time()
    (row,) = personal_data.digests(docs).collect()
    assert row["n_email"] == 20_000 and personal_data.redact(docs).first()["text"].count("[EMAIL]") == 20_000
    assert time.time() - began < 60


# Pages


def page(title, body, extra=""):
    return f'<html><head><title>{title}</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="box">Same on all</div>{extra}<article><header><h1>{title}</h1></header>{body}<div class="comments"><p>me too</p></div></article><footer>end</footer></body></html>'


def test_pages(spark, none):
    pages = [(i, f"https://u@Host.example:80/{i}", page(f"T{i} &amp; x", f"<p>one <b>bo</b>ld{i}<p>two\n  lines<br>here<!-- no --><ul><li>a<li>b</ul>")) for i in range(6)]
    free = [(10 + i, f"http://plain.example/{i}", f"<body><div><b>Menu</b> of site</div><div><p>own text {i}</p></div><div>Menu2</div></body>") for i in range(4)]
    odd = [(20, None, None), (21, "", ""), (22, "x", "no tags &lt;here"), (23, "http://h/", "<p>open <!-- never closed"), (24, "http://h/", "<div class='x>bad</div> <p a=\"b>q"), (25, "http://h/", "<p>" * 3000 + "deep" + "<div>" * 2000 + "er")]
    df = spark.createDataFrame(pages + free + odd + [free[0]], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("marks", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in site_templates.extract(df).collect()}
    assert all(got[i] == f"T{i} & x one bold{i} two lines here a b" for i in range(6))
    assert all(got[10 + i] == f"own text {i}" for i in range(4))
    assert (got[20], got[21], got[22], got[23]) == ("", "", "no tags <here", "open")
    assert got[25] == "deep er"
    assert site_templates.extract(df.limit(0)).count() == 0


def test_templates_inside_articles_and_at_any_depth(spark):
    deep = "<div>" * 600 + "<nav>MENU</nav><div>Shared</div><p>own {}</p>" + "</div>" * 600
    box = "<article><h2>Same</h2><p>Said in all</p><p>own {}</p><div><p>Letters</p><ul><li>Join</li></ul></div></article>"
    copied = "<article><p>copy</p><section><p>of a whole article</p></section></article>"
    loose = "<div><b>Menu</b> of {}</div><section>Site</section><p>own {}</p>"
    rows = [(f"http://{host}/{i}", html_.format(*[f"{host}{i}"] * 2)) for host, html_ in (("deep", deep), ("box", box), ("copied", copied), ("loose", loose)) for i in range(4)]
    rows += [(f"http://big/{i}", f"<body><div>{'Often' if i < 80 else f'once {i}'}</div><p>own {i}</p></body>") for i in range(200)]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {r["url"]: r["text"] for r in site_templates.extract(pages).collect()}
    off = {r["url"]: r["text"] for r in site_templates.extract(pages, least_pages=10**9).collect()}
    for i in range(4):
        assert got[f"http://deep/{i}"] == f"own deep{i}" and off[f"http://deep/{i}"] == f"Shared own deep{i}"
        assert got[f"http://box/{i}"] == f"Same Said in all own box{i}" and off[f"http://box/{i}"].endswith("Letters Join")
        assert got[f"http://copied/{i}"] == "copy of a whole article"
        assert got[f"http://loose/{i}"] == f"Menu of loose{i} own loose{i}"
    assert all(got[f"http://big/{i}"] == (f"own {i}" if i < 80 else f"once {i} own {i}") for i in range(200))


def test_no_text_is_lost(spark):
    """A page crawled again and mirrored is one page; what some pages share, and classes that only look like a word of the list, stay."""
    page = "<body><div><p>The only text</p><p>of a page</p></div></body>"
    rows = [("http://again/1", page)] * 3 + [(f"http://mirror/{i}", page) for i in range(5)] + [("http://versions/1", page.replace("of", f"version {i} of")) for i in range(5)]
    rows += [(f"http://large/{i}", f"<body><div><h2>{'Shared heading' if i < 10 else f'heading {i}'}</h2><p>own {i}</p></div></body>") for i in range(1000)]
    rows += [("http://classes/1", '<article><p class="ad-hoc">for this</p><p class="notice-period">a month</p><p class="x ad">buy</p><p id="share-price">up</p></article>')]
    rows += [("http://references/1", "<p>a &am<b>p;</b>lt; b &amp;lt; &#x26;lt; &lt<b>c</b></p>")]
    rows += [(f"http://same/{i}", f"<body><div><p>All say this</p></div>{'<p>once</p>' if i == 0 else '<!-- ' + str(i) + ' -->'}</body>") for i in range(4)]
    rows += [(f"http://chrome/{i}", f"<body><div><p>Menu</p></div><p>{i % 3 if i else 'Menu'}</p></body>") for i in range(30)]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {}
    for r in site_templates.extract(pages).collect():
        got.setdefault(r["url"], set()).add(r["text"])
    whole = "The only text of a page"
    assert got["http://again/1"] == {whole} and all(got[f"http://mirror/{i}"] == {whole} for i in range(5))
    assert got["http://versions/1"] == {f"The only text version {i} of a page" for i in range(5)}
    assert all(got[f"http://large/{i}"] == {f"Shared heading own {i}" if i < 10 else f"heading {i} own {i}"} for i in range(1000))
    assert got["http://classes/1"] == {"for this a month up"}
    assert got["http://references/1"] == {"a &amp;lt; b &lt; &lt; <c"}
    assert got["http://same/2"] == {"All say this"}


def test_counts_of_subtrees_against_plain_ones(spark):
    """Templates of random pages against a counter that goes through all pages of a host at once."""
    rng = random.Random(12)
    blocks = ["<div><p>menu</p></div>", "<ul><li>a</li><li>b</li></ul>", "<footer>end</footer>", "<section><p>x</p><div>deep</div></section>", "<p>plain</p>"]
    rows = [(rng.choice(("h", "k")), f"/{rng.randrange(25)}", "<body>" + "".join(rng.sample(blocks, rng.randrange(4))) + f"<p>{rng.randrange(40)}</p></body>") for _ in range(80)]
    pages = spark.createDataFrame([(i, f"http://{h}{u}", t) for i, (h, u, t) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    found = {r["host"]: set(r["marks"]) for r in site_templates.templates(site_templates._pages(pages, "page_id", "url", "html"), 3, 0.3).collect()}
    for host in ("h", "k"):
        seen, contents, urls = {}, set(), set()
        for h, u, t in rows:
            if h == host:
                root = site_templates.parse(t)
                whole, marks = site_templates.mark(root)
                contents.add(whole), urls.add(u)
                for m, _ in marks:
                    seen.setdefault(m, (set(), set()))
                    seen[m][0].add(u), seen[m][1].add(whole)
        pages_of_host = min(len(contents), len(urls))
        assert found.get(host, set()) == {m for m, (a, b) in seen.items() if min(len(a), len(b)) >= max(3, 0.3 * pages_of_host)}


def body(page):
    """The article of a supplied page, as markup."""
    inner = page.split("<article>", 1)[1]
    return inner.split("</article>")[0] if "</article>" in inner else inner.split("<footer>")[0]


def plain(markup):
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\n", markup))).split())


def test_templates_alone_find_the_article(spark):
    """The supplied articles in pages that mark nothing: each host has a menu, an advert and a footer of its own, all in plain elements."""
    hosts = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        hosts.setdefault(r["url"].split("/")[2], []).append(r)
    rows, want = [], {}
    for host, found in hosts.items():
        menu, ad, foot = f"<ul><li>Home of {host}</li><li><b>News</b></li></ul>", f"Buy at {host}", f"&copy; {host}"
        for r in found if len({plain(body(r["html"])) for r in found}) >= 4 else ():
            rows.append((r["page_id"], r["url"], f"<body><div>{menu}</div><div>{ad}</div><div>{body(r['html'])}</div><div>{foot}</div></body>"))
            want[r["page_id"]] = plain(body(r["html"]))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = {r["page_id"]: r["text"] for r in site_templates.extract(pages).collect()}
    off = {r["page_id"]: r["text"] for r in site_templates.extract(pages, least_pages=10**9).collect()}
    assert len(want) > 100 and told.keys() == want.keys()
    assert sum(told[i] == want[i] for i in want) > 0.95 * len(want) and not any(off[i] == want[i] for i in want)


def test_pages_of_the_small_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        want[r["page_id"]] = plain(body(r["html"]))
    assert {r["page_id"]: r["text"] for r in site_templates.extract(pages).collect()} == want


# Quality and languages


def test_quality_on_held_out_rows(spark, odd, none):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    said = quality.score_quality(docs.union(docs.limit(3)), labels, fold("doc_id", 5) != 0).join(labels.where(fold("doc_id", 5) == 0), "doc_id")
    right = said.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    scored = quality.score_quality(odd, labels.limit(0), F.lit(True)).collect()
    assert len(scored) == len(odd_texts()) and {r["score"] for r in scored} == {0.5}
    rows = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (9, 1), (10, None), (7, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.score_quality(odd, rows, F.lit(True)).collect())
    assert quality.score_quality(none, rows, F.lit(True)).count() == 0


def test_the_descent_separates_what_is_separable():
    rng = np.random.default_rng(0)
    examples = [(np.unique(np.concatenate([rng.integers(0, 50, 10), [100 + y]])).astype(np.uint64), int(y), bool(k % 5 == 0)) for k, y in enumerate(rng.integers(0, 2, 200))]
    model = quality.fit(examples)
    flat, row = np.concatenate([e[0] for e in examples]), np.repeat(np.arange(200), [len(e[0]) for e in examples])
    assert ((model.scores(row, flat, 200) > 0.5) == np.array([e[1] for e in examples])).all()


def test_models_against_plain_ones():
    """Interpolated Kneser-Ney from dictionaries, symbol by symbol."""
    rng, order = random.Random(7), 4
    rows: dict = {}
    for lang, letters in (("aa", "abcd"), ("bb", "bcde"), ("cc", "xyz")):
        for _ in range(120):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
            text = "\0" * (order - 1) + word + "\0"
            for i in range(len(word) + 1):
                rows[lang, text[i : i + order]] = rows.get((lang, text[i : i + order]), 0) + 1
    models = language_id.Models([(a, b, n) for (a, b), n in rows.items()], order)
    symbols = len({g[-1] for _, g in rows}) + 1

    def plain(lang):
        counts = {order: {g: n for (k, g), n in rows.items() if k == lang}}
        for n in range(order - 1, 0, -1):
            counts[n] = {}
            for g in counts[n + 1]:
                counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
        total, kinds, discount = {}, {}, {}
        for n, c in counts.items():
            ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            discount[n] = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
            for g, x in c.items():
                total[g[:-1]] = total.get(g[:-1], 0) + x
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1

        def p(g):
            if not g:
                return 1 / symbols
            n, before, lower = len(g), g[:-1], p(g[1:])
            if before not in total:
                return lower
            return max(counts[n].get(g, 0) - discount[n], 0) / total[before] + discount[n] * kinds[before] / total[before] * lower

        return p

    of = [plain(x) for x in models.langs]
    for words_ in (["abc", "d"], ["xyzzy"], ["q"], ["bbbb", "e", "cab"], ["aqx"]):
        got = models.score([words_])[0]
        want = np.zeros(3)
        for w in words_:
            text = "\0" * (order - 1) + w + "\0"
            for i in range(len(w) + 1):
                want += [np.log(p(text[i : i + order])) for p in of]
        assert np.allclose(got[:3], want, rtol=1e-4) and got[3] == sum(len(w) + 1 for w in words_)


def test_models_are_distributions():
    rng = random.Random(4)
    rows = {}
    for lang in ("aa", "bb"):
        for _ in range(300):
            text = "\0" * 2 + "".join(rng.choice("abcde" if lang == "aa" else "cdefg") for _ in range(rng.randrange(1, 6))) + "\0"
            for i in range(len(text) - 2):
                rows[lang, text[i : i + 3]] = rows.get((lang, text[i : i + 3]), 0) + 1
    models = language_id.Models([(a, b, n) for (a, b), n in rows.items()], 3)
    # over the next symbol after a context: known symbols, the end, and one unknown symbol
    for context in ("ab", "cc", "g"):
        total = np.zeros(2)
        before = models.score([[context]])[0][:2]
        end = models.score([[context]])[0][:2]
        stem = sum(np.exp(models.score([[context + c]])[0][:2]) * 0 for c in "a")
        for c in "abcdefg":
            longer = models.score([[context + c]])[0][:2]
            # p(context c end) / p(end | context c) is p(context c)
            total += np.exp(longer - _end(models, context + c))
        total += np.exp(end)
        start = np.exp(before - _end(models, context))
        assert np.all(total <= start * 1.0001 + stem) and np.all(total >= start * 0.98)


def _end(models, text):
    """log p(end | text) from scores of the text with and without another end."""
    padded = "\0" * (models.order - 1) + text + "\0"
    at = np.frombuffer(padded.encode("utf-32-le"), np.uint32)
    h = language_id._roll(language_id._symbols(at), models.order)
    total, i = np.zeros(len(models.langs)), len(at) - 1
    for n in range(models.order, 0, -1):
        k, ok = language_id._find(models.keys[n - 1], h[n - 1][i : i + 1])
        if ok[0]:
            return total + models.logp[n - 1][k[0]]
        if n > 1:
            k, ok = language_id._find(models.contexts[n - 1], h[n - 2][i - 1 : i])
            if ok[0]:
                total = total + models.weights[n - 1][k[0]]
    return total + models.weights[0][0] + models.base


def test_languages_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = language_id.identify(docs, fold("doc_id", 3) != 1).where(fold("doc_id", 3) == 1).join(docs.select("doc_id", "lang"), "doc_id")
    right, rejected = said.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right > 0.98 and rejected < 0.005
    foreign = spark.createDataFrame([(1, "въпросът не е дали ще стане а кога точно ще стане това нещо"), (2, None), (3, "12 + 4 = 16"), (4, "qxz vvkw jjqq zzxk wqqx kkvj " * 20)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").union(foreign.select(-F.col("doc_id"), "text", F.lit(None)))
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.identify(both, F.lit(True)).where("doc_id < 0").collect()}
    assert got[-2] == got[-3] == ("und", True) and got[-1][1] and got[-4][1]
    untaught = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert len(untaught) == len(odd_texts()) and {(r["lang_pred"], r["score"], r["rejected"]) for r in untaught} == {("und", 0.0, True)}
    assert language_id.identify(none.withColumn("lang", F.lit("en")), F.lit(True)).count() == 0
