"""Operators that work row by row, against the libraries they must equal or an exact round trip."""

import base64
import hashlib
import html as htmllib
import random
import time
import zlib

import numpy as np
import public_tokenizers as files
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import texts
from tidemill.llm import byte_bpe, html_text, media, queries, token_counts

PIECES = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "é", "e\u0301", "日本", "😀", "'s", "'LL", "12", "!?", "<|endoftext|>", "\r\n", "ſ", "İ", "Σ", "the", "ing", "aaaa", "\x00", "ᄀ", "ᅡ", ".", ","]
mixed = st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=30).map("".join).filter(lambda s: "\ud800" > max(s, default="") or all(not 0xD800 <= ord(c) < 0xE000 for c in s))


@pytest.fixture(scope="module")
def ranks():
    with open(files.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=table, special_tokens={})


COUNTER = token_counts.counter(files.path("byte_bpe_50k.json"), files.PATTERN)
LIBRARY = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
CODEC = byte_bpe.codec(files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)


@settings(max_examples=300, deadline=None)
@given(mixed)
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_ids_equal_tiktoken(ranks):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))
        ids = CODEC.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == ranks.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode()
        e = CODEC.library.encode(text, add_special_tokens=False)
        assert list(zip(*(x.tolist() for x in CODEC.offsets(ids, text.encode())))) == e.offsets and e.ids == np.frombuffer(ids, "<u4").tolist()


def test_latin_texts_equal_the_libraries(ranks):
    rng, every = random.Random(6), "".join(map(chr, range(256)))
    for _ in range(3000):
        text = "".join(rng.choice(every if rng.random() < 0.6 else "ab 's\n .1") for _ in range(rng.randrange(30)))
        assert token_counts.is_latin(text) and COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ranks.encode_ordinary(text)
    assert token_counts.latin_pattern(r"\\w+") is None and token_counts.latin_pattern("(a)b") is None


def test_offsets_cover_split_characters():
    starts, ends = CODEC.offsets(CODEC.encode("a😀é"), "a😀é".encode())
    assert (starts[0], ends[0]) == (0, 1) and {c for a, b in zip(starts, ends) for c in range(a, b)} == {0, 1, 2}
    assert [len(x) for x in CODEC.offsets(b"", b"")] == [0, 0]


def test_tables_of_bytes_are_each_others_reverse():
    everything = bytes(range(256))
    ids = np.array([CODEC.names.index(c) for c in map(CODEC.letters.__getitem__, everything)], "<u4").tobytes()
    assert CODEC.decode(ids) == everything


def test_token_counts_of_all_cases(docs, empty):
    run = lambda d: token_counts.token_counts(d, "doc_id", "text", files.path("byte_bpe_50k.json"), files.PATTERN)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(docs).collect()), key=str)
    count = lambda t: len(LIBRARY.encode(t, add_special_tokens=False).ids)
    assert got == sorted(((i, len(t.encode()), count(t), count(t) > 512) for i, t in texts(docs)), key=str)
    assert run(empty).count() == 0


def test_byte_bpe_of_all_cases(docs, empty, ranks):
    run = lambda d: byte_bpe.round_trip(d, "doc_id", "text", files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    spans = lambda t: np.array(CODEC.library.encode(t, add_special_tokens=False).offsets, "<i8").reshape(-1, 2).T.tobytes()
    want = sorted(((i, len(e := ranks.encode_ordinary(t)), sha(np.array(e, "<u4").tobytes()), sha(t.encode()), sha(spans(t))) for i, t in texts(docs)), key=str)
    assert sorted((tuple(r) for r in run(docs).collect()), key=str) == want
    assert run(empty).count() == 0
    there = byte_bpe.encode(docs.filter("doc_id <> 9"), "doc_id", "text", files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)
    back = byte_bpe.decode(there, "doc_id", "ids", files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t) for i, t in texts(docs) if i not in (9, None))


def test_crc16_by_long_division():
    data = bytes(random.Random(1).randrange(256) for _ in range(34))
    bits = [int(b) for byte in data for b in f"{byte:08b}"]
    crc = [1] * 16
    for b in bits:
        top = crc.pop(0) ^ b
        crc.append(0)
        if top:
            crc = [c ^ p for c, p in zip(crc, [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1], strict=True)]
    want = int("".join(map(str, crc)), 2)
    assert media.crc16(data) == want


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(data):
    p = media.padded(data)
    assert len(p) % 576 == 0 and len(p) >= 576 and p.startswith(data) and set(p[len(data) :]) <= {255}
    r = media.read(media.wrap(p))
    assert r["payload"] == p and not r["bad"] and not r["skipped"] and r["samples"] == 1152 * (len(p) // 576) and r["vbr"]["frames"] == len(r["offsets"])
    assert all(media.header(media.wrap(p)[x : x + 4]) for x in r["offsets"]) and r["checked"] == len(r["offsets"]) + 1


def test_media_resynchronises():
    p = media.padded(b"\xff\xfb" * 900)
    m = media.wrap(p)
    tag = media.read(b"")
    assert tag["samples"] == 0 and media.feature(tag).startswith("frames=0")
    r = media.read(b"\xff" * 41 + m[m.index(b"\xff\xfa") :] + b"TAGtitle".ljust(128, b"\0"))
    assert r["payload"] == p and r["skipped"] == 41 and r["tags"]["ID3v1"] == "title"
    broken = bytearray(m)
    start = m.index(b"\xff\xfa")
    broken[start + media.FRAME + 20] ^= 1  # in the side information, which the checksum covers
    r = media.read(bytes(broken))
    assert r["bad"] == 1 and r["payload"] == p[576:]
    cut = m[: start + media.FRAME] + m[start + media.FRAME + 300 :]
    assert media.read(cut)["payload"] == p[576:]


def frame_of(h, body=b"", crc=None):
    """A frame with this header, filled up with zeros; ``crc``: how many bits after the checksum it covers."""
    size = media.header(h)[0]
    if crc is not None:
        body = media.crc16(h[2:] + body, 16 + crc).to_bytes(2, "big") + body
    return (h + body).ljust(size, b"\0")


LAYER_3, LAYER_2, LAYER_1 = (bytes([0xFF, b, 0x94, 0x00]) for b in (0xFB, 0xFC, 0xFE))  # the latter two with a CRC; 48 kHz


def test_tables_in_front_are_no_sound():
    sound = [frame_of(LAYER_3) for _ in range(5)]
    lame = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    xing = b"Xing" + (15).to_bytes(4, "big") + (5).to_bytes(4, "big") + (9000).to_bytes(4, "big") + bytes(range(100)) + bytes(4)
    r = media.read(frame_of(LAYER_3, bytes(32) + xing + lame) + b"".join(sound))
    assert r["vbr"] == {"kind": "Xing", "frames": 5, "bytes": 9000, "toc": list(range(100)), "before": 576, "after": 1000}
    assert r["samples"] == 5 * 1152 - 1576 and r["offsets"] == [len(sound[0]) * k for k in range(1, 6)]
    vbri = b"VBRI" + bytes(6) + (9000).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 2, 100, 200, 300))
    r = media.read(frame_of(LAYER_3, bytes(32) + vbri) + b"".join(sound))
    assert r["vbr"] == {"kind": "VBRI", "bytes": 9000, "frames": 5, "each": 2, "table": [0, 200, 600]} and r["samples"] == 5 * 1152
    r = media.read(b"".join(sound))
    assert r["vbr"] == {} and r["samples"] == 5 * 1152 and r["offsets"][0] == 0


def test_checksums_of_layers():
    """Allocations by hand: Layer I has 4 bits a subband and channel; Layer II, 144 kbit/s a channel at 48 kHz, has 2 x 88 bits of
    allocation (11 of 4, 12 of 3, 4 of 2 bits) and 2 more for each that isn't zero."""
    first = bytes(range(1, 33))
    second = (0b0101 << 172).to_bytes(22, "big") + b"\xc0" + bytes(9)
    assert media.guarded_bits(frame_of(LAYER_1), media.header(LAYER_1)) == 256
    for h, body, bits, samples in ((LAYER_1, first, 256, 384), (LAYER_2, second, 2 * 88 + 2, 1152)):
        good = frame_of(h, body, bits)
        r = media.read(good * 3)
        assert (r["checked"], r["bad"], r["samples"]) == (3, 0, 3 * samples)
        broken = bytearray(good)
        broken[7] ^= 8
        assert media.read(good + bytes(broken) + good)["bad"] == 1
        tail = bytearray(good)
        tail[-1] ^= 1  # not covered
        assert media.read(bytes(tail) * 2)["bad"] == 0
    joint = bytes([0xFF, 0xFE, 0x94, 0x40])  # one allocation for both channels from the fourth subband on
    assert media.guarded_bits(frame_of(joint), media.header(joint)) == 4 * (32 + 4)


def test_tags_of_all_versions():
    def v3(name, body):
        return name + len(body).to_bytes(4, "big") + b"\0\0" + body

    def whole(version, body, flags=0):
        return b"ID3" + bytes([version, 0, flags]) + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body

    album, sound = "x" * 200, frame_of(LAYER_3) * 2
    frames = v3(b"TIT2", b"\1" + "Títle 日本".encode("utf-16")) + v3(b"TALB", b"\0" + album.encode()) + v3(b"TPE1", b"\2" + "Ärtist".encode("utf-16-be") + b"\0\0") + v3(b"APIC", b"\0" * 300)
    want = {"TIT2": "Títle 日本", "TALB": album, "TPE1": "Ärtist"}
    assert media.read(whole(3, frames) + sound)["tags"] == want
    assert media.read(whole(3, (6).to_bytes(4, "big") + bytes(6) + frames, 64) + sound)["tags"] == want
    assert media.read(whole(3, frames.replace(b"\xff", b"\xff\0"), 128) + sound)["tags"] == want
    short = b"TT2" + (5).to_bytes(3, "big") + b"\0four" + b"TP1" + (3).to_bytes(3, "big") + b"\0me"
    assert media.read(whole(2, short) + sound)["tags"] == {"TT2": "four", "TP1": "me"}
    assert media.read(media.tag({"TIT2": "ü" * 100, "TPE1": "a\0b"}) + sound)["tags"] == {"TIT2": "ü" * 100, "TPE1": "a/b"}
    last = b"TAG" + b"t".ljust(30, b"\0") + b"a".ljust(30) + bytes(65)
    r = media.read(whole(3, frames[:-40]) + sound + last)
    assert r["tags"]["ID3v1"] == "t" and r["tags"]["ID3v1.artist"] == "a" and r["skipped"] == 0 and r["samples"] == 2304


def test_the_last_frame_counts_whatever_follows():
    """Ten frames without a checksum, and then padding or tags; an APE tag with a header, and one that only its footer tells of."""
    sound = frame_of(LAYER_3) * 10
    item = lambda k, v: len(v).to_bytes(4, "little") + bytes(4) + k + b"\0" + v
    body = item(b"Title", b"t\xc3\xa9") + item(b"Year", b"2001")
    head = lambda flags: b"APETAGEX" + b"".join(x.to_bytes(4, "little") for x in (2000, len(body) + 32, 2, flags)) + bytes(8)
    fields = b"LYRICSBEGIN" + b"IND00002" + b"10" + b"LYR00004" + b"la\r\n"
    lyric = fields + f"{len(fields):06}".encode() + b"LYRICS200"
    old = b"LYRICSBEGINla laLYRICSEND"
    last = b"TAG" + b"t".ljust(125, b"\0")
    names = {"APE.Title": "té", "APE.Year": "2001"}
    for tail, tags, skipped in (
        (b"", {}, 0), (bytes(500), {}, 500), (b"\x07" * 40, {}, 40), (head(1 << 31 | 1 << 29) + body + head(1 << 31), names, 0), (body + head(0), names, 0),
        (lyric, {"LYRICS.IND": "10", "LYRICS.LYR": "la\r\n"}, 0), (old + last, {"LYRICS.LYR": "la la", "ID3v1": "t"}, 0), (body + head(0) + last, {**names, "ID3v1": "t"}, 0), (body + head(0) + lyric + last, {**names, "LYRICS.IND": "10", "LYRICS.LYR": "la\r\n", "ID3v1": "t"}, 0),
    ):
        r = media.read(sound + tail)
        assert (len(r["offsets"]), r["samples"], r["tags"], r["skipped"], r["bad"]) == (10, 11520, tags, skipped, 0), tail
    assert len(media.read(frame_of(LAYER_3) + lyric)["offsets"]) == 1


def test_rates_that_change_add_up():
    other = bytes([0xFF, 0xFB, 0x90, 0x00])
    assert media.header(other)[2] == 44100
    r = media.read(frame_of(other) * 10 + frame_of(LAYER_3) * 10)
    assert r["lengths"] == [[44100, 11520], [48000, 11520]] and r["seconds"] == pytest.approx(11520 / 44100 + 11520 / 48000)
    assert "samples=11520/44100+11520/48000;" in media.feature(r)


def test_free_format():
    """Frames of 1000 bytes, every third padded by one, which no bit rate of the tables gives."""
    head = lambda pad: bytes([0xFF, 0xFB, 0x04 | pad << 1, 0x00])
    sound = b"".join((head(i % 3 == 0) + bytes(32)).ljust(1000 + (i % 3 == 0), b"\7") for i in range(12))
    for tail in (b"", bytes(300)):
        r = media.read(b"xx" + sound + tail)
        assert len(r["offsets"]) == 12 and r["samples"] == 12 * 1152 and r["skipped"] == 2 + len(tail) and r["offsets"][:3] == [2, 1003, 2003]
    assert media.read(head(0) + bytes(500))["offsets"] == []


@pytest.mark.parametrize("unit", [b"\xff", b"\0", b"ID3", b"TAG", b"\xff\xfb\x90\x00", b"\xff\xfa\x90\x00", b"\xff\xfb\x00\x00", b"APETAGEX", b"LYRICSBEGIN", b"\xff\xfb", b"ID3\x04\0\0\0\0\0\0", b"\xff\xfb\x00\x00" + b"\1" * 60])
def test_reading_is_linear(unit):
    import time

    data, at = unit * (1_000_000 // len(unit)), time.perf_counter()
    media.read(data)
    assert time.perf_counter() - at < 5


def test_media_of_all_cases(docs, empty):
    run = lambda d: media.probe(media.encode(d, "doc_id", "text"), "doc_id")
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in run(docs).collect()}
    pad = lambda t: media.padded(t.encode())
    assert got == {(i, len(t.encode()), len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-32:])) for i, t in texts(docs)}
    same = [r for r in run(docs).collect() if r.doc_id in (1, 2)]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature
    assert run(empty).count() == 0


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">menu, menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies, lots, of, them, here, and there.</div><div class="ad">Buy, now, please, buy.</div>{}<aside class="sidebar"><p>Side, a, b, c, d, e, f, g.</p></aside>
<section id="comments"><p>nice, post, really, great, comment, indeed, so, much, more, text</p></section><form><p>sign, up, now</p></form><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("wrapper", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div><div id="post-body">{}</div></div>', "<article><header>{}</header></article>", '<div class="page with-sidebar no-nav"><div class="elementor-widget">{}</div></div>', '<div id="wrap" class="header-menu-open banner"><div role="main">{}</div></div>', '<div class="sidebar-right"><main class="col">{}</main></div>', '<main><div class="post-header"><p></p></div><article>{}</article><section class="comments"><article class="comment"><p>so, good, so, long, so, many, commas, here, in, this, one</p></article></section></main>'])
def test_articles(wrapper):
    body = "<h1>A  head\nline</h1><p>First, of some words, &amp; more&nbsp;here that go on, and on, for a while.<p>Second <b>bold</b><br>text, that is long enough, to be read as such.</p><p>Third.</p>"
    want = "A head line\nFirst, of some words, & more here that go on, and on, for a while.\nSecond bold text, that is long enough, to be read as such.\nThird."
    assert html_text.extract(PAGE.format(wrapper.format(body))) == want


@pytest.mark.parametrize(("html", "want"), [("", ""), ("plain &lt; text", "plain < text"), ("<p>", ""), ("<article></article>", ""), ("<article><p>x</article>", "x"), ("a &am", "a &am"), ("<nav>menu</nav>", ""), ("<p>a<!-- b -->c</p>", "ac")])
def test_odd_pages(html, want):
    assert html_text.extract(html) == want


HEAD_P = "<h1>Head</h1><p>First para, with words, and more words to read on a day.</p><p>Second para, that has, some commas, and words enough.</p>"
HEAD_TEXT = "Head\nFirst para, with words, and more words to read on a day.\nSecond para, that has, some commas, and words enough."
NAV, FOOT = "<nav><ul><li><a href=x>menu</a></li></ul></nav>", "<footer><p>Copyright, all rights reserved</p></footer>"
READERS = '<section id="comments"><article class="comment"><p>so, good, so, long, so, many, commas, here, in, this, one, and it goes on and on and on, and on</p></article></section>'
AROUND = {
    "no end of head": f"<html><head><title>t</title><meta charset=utf-8><body>{NAV}<article>@</article>{FOOT}",
    "no head's end, no body": f"<html><head><title>t</title>{NAV}<article>@</article>{FOOT}",
    "no head": f"<title>t</title>{NAV}<article>@</article>{FOOT}",
    "one form": f"<body><form action=x><input>{NAV}<div id=c>@</div>{FOOT}</form></body>",
    "one form with an article": f"<body><form action=x><input>{NAV}<article>@</article>{FOOT}</form></body>",
    "a class with social": f'<body>{NAV}<article class="social-science">@</article>{FOOT}',
    "a class with sidebar": f'<body>{NAV}<div class="page-sidebar-left">@</div>{FOOT}',
    "a class with share": f'<body>{NAV}<div class="share-price-report">@</div>{READERS}{FOOT}',
    "comments in the article": f"<body>{NAV}<article>@{READERS}</article>{FOOT}",
    "comments after it": f'<body>{NAV}<main>@</main><div class="comments">{READERS}</div>{FOOT}',
    "an article as a comment": f'<body>{NAV}<main><article>@</article></main><div class="comments"><article><p>so, good, so, long, so, many, commas</p></article></div>{FOOT}',
    "more comments than text": f"<body>{NAV}<div id=x>@{READERS}{READERS}{READERS}</div>{FOOT}",
    "related articles": f'<body>{NAV}<article>@<div class="related"><article><h2>More</h2><p>x, y, z, and more teaser text, there</p></article></div></article>',
    "an empty comment": f"<body><!-->{NAV}@<!-- z -->{FOOT}",
    "a header with a slogan": '<body><header><h1>Site</h1><p>The slogan, of it</p></header><div class="social-layout">@</div>',
    "many wrappers": "<body>" + '<div class="wrap sidebar-x">' * 80 + "@" + "</div>" * 80,
    "an advert inside": f'<body>{NAV}<div id=c><div class=ad>Buy, buy, buy</div>@</div>{FOOT}',
    "hidden parts": '<body><article>@<p hidden>no</p><p style="display: none">no</p></article>',
}


@pytest.mark.parametrize("name", AROUND)
def test_frames_do_not_hide_the_article(name):
    assert html_text.extract(AROUND[name].replace("@", HEAD_P)) == HEAD_TEXT


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>Take <math><mi>x</mi><mo>+</mo><mn>1</mn></math> now.</p></article>", "Take x+1 now."),
        (f"<body>{NAV}<div id=c><section>{HEAD_P * 3}</section><section><p>Small one.</p><p>Another.</p></section></div>{FOOT}", "\n".join([HEAD_TEXT] * 3 + ["Small one.", "Another."])),
        (f"<body>{NAV}<div id=c><div>{HEAD_P}</div><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></div>{FOOT}", HEAD_TEXT + "\none\ntwo\na\nb"),
        (f'<body><article></article>{FOOT}<div class="cookie-notice"><p>cookies, and, so on</p></div>', ""),
    ],
)
def test_parts_of_one_text(html, want):
    assert html_text.extract(html) == want


def test_pages_without_article_elements():
    """Random pages of plain containers against the blocks that they were made of."""
    rng = random.Random(12)
    words = lambda least, most: " ".join(rng.choice(("alpha", "beta,", "gamma", "delta", "omega.")) for _ in range(rng.randrange(least, most)))

    def part(depth: int) -> tuple[str, list[str]]:
        html, texts = "", []
        for _ in range(rng.randrange(2, 5)):
            way = rng.randrange(6 if depth else 4)
            if way < 2:
                t = [words(12, 60)]
                html += f"<p>{t[0]}" + rng.choice(("", "</p>"))
            elif way == 2:
                t = [words(2, 6), words(12, 60)]
                html += f"<h2>{t[0]}</h2><p>{t[1]}</p>"
            elif way == 3:
                t = [words(8, 20) for _ in range(3)]
                html += "<ul>" + "".join(f"<li>{x}" for x in t) + "</ul>"
            else:
                inner, t = part(depth - 1)
                html += rng.choice(("<div>{}</div>", "<section>{}</section>", '<div class="box with-nav">{}</div>')).format(inner)
            texts += t
        return html, texts

    for _ in range(300):
        html, texts = part(3)
        page = f'<body>{NAV}<div class="sidebar"><p>{words(5, 30)}</p></div><div id="x"><div class="ad">Buy, now.</div><h1>Title</h1>{html}<div class="share">Share this</div></div>{READERS}<form><input>Search, here</form>{FOOT}'
        assert html_text.extract(page) == "\n".join(["Title", *texts])


def test_extraction_is_linear():
    n = 20_000
    for html in ("<blockquote>" * n + "<p>a, b</p>", '<div class="nav">' * n + "<p>a, b</p>", '<section class="banner">' * n + "<main><p>a, b</p>"):
        begun = time.process_time()
        assert html_text.extract(html) == "a, b" and time.process_time() - begun < 5


def story(n=6):
    return "".join(f"<p>The story goes on, and on, and on, in sentence number {i} of it.</p>" for i in range(n))


def told(n=6):
    return "\n".join(f"The story goes on, and on, and on, in sentence number {i} of it." for i in range(n))


@pytest.mark.parametrize("tag", ["<p title=it's>{}", "<h2 title=Editor's>{}", "<p title=a\"b'c>{}", "<p data-x='a>b' title=\"c>d\">{}", "<p title = it's class=x>{}", "<p =x>{}", "<p a=>{}"])
def test_quotes_in_attributes(tag):
    html = f"<article>{story()}{tag.format('First of them.')}</{tag[1 : 2 + (tag[1] == 'h')]}></article>"
    assert html_text.extract(html) == told() + "\nFirst of them."


@pytest.mark.parametrize("part", ['<div class="commentBody"><p>{}</p></div>', '<div id="userComments"><p>{}</p></div>', '<div class="siteFooter"><p>{}</p></div>', '<div class="adBox"><p>{}</p></div>', '<ins class="adsbygoogle"><p>{}</p></ins>'])
def test_names_in_camel_case(part):
    text = "Something else, here, and there, that is no part of it, not at all."
    for html in (f"<body><article>{story()}</article>{part.format(text)}</body>", f"<body><div>{story()}{part.format(text)}</div></body>"):
        assert html_text.extract(html) == told()
    assert "Cool" in html_text.extract(f'<body><article><div class="headlineBox"><p>Cool, text, here.</p></div>{story()}</article></body>')


@pytest.mark.parametrize("frame", ['<div class="reader-responses">{}</div>', '<ol class="responses">{}</ol>', '<section id="discussion">{}</section>', "<ul>{}</ul>"])
def test_comments_by_their_make_up(frame):
    item = "li" if frame[1] in "ou" else "div"
    notes = "".join(f"<{item}><span class='userName'>Ann {i}</span> <time>1 May</time><p>Well said, I think, and so does everyone, number {i}.</p></{item}>" for i in range(4))
    for html in (f"<body><article>{story()}</article>{frame.format(notes)}</body>", f"<body><div class=content>{story()}</div>{frame.format(notes)}</body>"):
        assert html_text.extract(html) == told()
    results = f"<article>{story()}<section id='discussion'><p>We discuss, at length, what this means.</p><p>And more, of it, here.</p></section></article>"
    assert html_text.extract(results) == told() + "\nWe discuss, at length, what this means.\nAnd more, of it, here."


def test_articles_side_by_side():
    other = story().replace("story", "tale")
    teaser = "<article><a href=x>Read this, too</a></article>"
    assert html_text.extract(f"<body><article>{story()}</article><article>{other}</article>{teaser}</body>") == told() + "\n" + told().replace("story", "tale")


@pytest.mark.parametrize("unit", ["</x", "<a '", '<a b="', "<a =", "<!--", "<!", "<", "</", "<a b='", "<p ", "<?x", "<li><ul class=responses>", "<a b=c"])
def test_pages_are_parsed_in_linear_time(unit):
    import time

    at = time.perf_counter()
    html_text.extract(unit * 60_000)
    assert time.perf_counter() - at < 6


def test_long_and_deep_pages():
    assert html_text.extract("<div>" * 20_000 + "<p>deep text</p>") == "deep text"
    assert len(html_text.extract("<article>" + "<p>a, b</p>" * 30_000)) == 5 * 30_000 - 1


def test_articles_of_the_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op10_html_text(spark, sf_dir).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        for tag in ("<b>", "</b>", "<br>"):
            article = article.replace(tag, " ")
        for tag in ("<p>", "</p>", "<h1>", "</h1>"):
            article = article.replace(tag, "\x01")
        want = "\n".join(x for x in (" ".join(htmllib.unescape(x).split()) for x in article.split("\x01")) if x)
        assert r.text == want and r.n_chars == len(want)


def test_pages_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>t</p>", "x"), (None, "u", "<p>t</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(rows).collect()), key=str) == [(1, "", 0), (None, "t", 1), (None, "t", 1)]
    assert html_text.main_text(rows.filter("false")).count() == 0
