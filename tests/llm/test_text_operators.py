"""Operators on single texts against plain Python on whole texts."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from paperloom.llm import encoding
from paperloom.llm.encoding import Encoder, encoder
from paperloom.llm.html_text import extract_pages, main_text
from paperloom.llm.lengths import context_totals, length_histogram
from paperloom.llm.pii import KINDS, detect, disguised, luhn, scan_pii
from paperloom.llm.secret_scan import scan_secrets
from paperloom.llm.tokens import read_tokens, token_digest, write_tokens
from paperloom.llm.words import shingle_sets, word_hashes

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|>\n<|endoftext|>y, <|endoftext|", "", " ", "a", "two  spaces", " lead", "trail ", "a\n\nb \n c", "it's we'll 12 345", "<|endoftext|> x", "naïve ÇA b 日本", "\t\tx  y", "a b c"]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_like_whole_texts():
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab 'sT1\n\t.,é ") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts = ODD + noise + ["long word " * 3000]
    ids, upto = encoder(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == whole(texts)


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    class Counting:
        def __init__(self):
            self.library, self.texts = Tokenizer.from_file(PATH), 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.library.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(self.library, name)

    used = Encoder(PATH)
    used.tokenizer = Counting()
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé,.%\\1") for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    texts = [" ".join(words[i : i + 300]) + "\n" + "\n".join(words[i : i + 3]) for i in range(0, 6000, 300)]
    texts += ["", "a\tb  c", " x", "y\n", "it's,it'll", "tab\t,", "\u1680wide \u1680,", "\n\nx\n\n"]
    for _ in range(2):
        ids, upto = used.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == whole(texts)
        monkeypatch.setattr(encoding, "KEPT_WORDS", 50)  # most are dropped and come back
    assert used.tokenizer.texts < 100


def test_token_files_round_trip(spark, docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (50, None)]
    write_tokens(docs(rows), str(tmp_path / "t"))
    got = [tuple(r) for r in token_digest(spark, str(tmp_path / "t")).orderBy("start").collect()]
    expected, start = [], 0
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    ids = [w + [2] for w in whole([t for _, t in texts])]
    assert [g[0] for g in got] == [i for i, _ in texts]
    for g, (i, _) in zip(got, texts, strict=True):
        assert g[1] == start and g[0] == i
        start += g[2]
    for (i, _), w in zip(texts, ids, strict=True):
        expected.append((i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())))
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted(expected)
    few = read_tokens(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")
    assert "tokens" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].replace("n_tokens", "")
    write_tokens(docs(rows).limit(0), str(tmp_path / "none"))
    assert token_digest(spark, str(tmp_path / "none")).count() == 0


def test_context_totals(docs):
    rows = [(i, "word " * (i % 7), None if i % 3 else "b") for i in range(40)] + [(99, None, "b")]
    lengths = [(r[2], len(w)) for r, w in zip(rows, whole([r[1] or "" for r in rows]), strict=True)]
    found = context_totals(length_histogram(docs(rows))).collect()
    for overall, sources in ((True, {None, "b"}), (False, {None}), (False, {"b"})):
        own = [n for s, n in lengths if s in sources]
        part = [r for r in found if r.overall == overall and (overall or r.source in sources)]
        assert {r.length for r in part} == set(own)
        for r in part:
            assert r.tokens_kept == sum(min(n, r.length) for n in own) and r.tokens_total == sum(own)
            assert r.docs_over == sum(n > r.length for n in own)
            assert abs(r["quantile"] - sum(n <= r.length for n in own) / len(own)) < 1e-12
    assert context_totals(length_histogram(docs(rows).limit(0))).count() == 0


def secrets_by_regex(t):
    found = []
    key = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(docs):
    rng = random.Random(3)
    words = ["password", "=", ": ", "token:abc", "API_KEY='", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é", "\u0001", " ", "\n", "abcdef", "secret"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", "password=token:abcdefgh", "x" * 5000]
    got = {r.doc_id: r for r in scan_secrets(docs(list(enumerate(texts)))).collect()}
    names = ["assign", "access", "hex"]
    for i, t in enumerate(texts):
        spans = secrets_by_regex(t or "")
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert set(text.split(",")) <= set(got[i].spans.split(","))


def test_window_entropy(docs):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(alphabet) for _ in range(40))
    texts = [f"see {key} here", "nonononononononononono1", "a1" * 30, f"example{key}", "A" * 25 + key, "0f" * 40 + "é"]
    got = [r.spans for r in scan_secrets(docs(list(enumerate(texts)))).orderBy("doc_id").collect()]

    def windows(c, bits):
        def h(w):
            return -sum(w.count(x) / 20 * np.log2(w.count(x) / 20) for x in set(w))

        high = [i for i in range(len(c) - 19) if h(c[i : i + 20]) >= bits - 1e-12]
        return (high[0], high[-1] + 20) if high else None

    a, b = windows(key, 3.8)
    assert got[0] == f"entropy:{4 + a}:{4 + b}"
    assert got[1:4] == ["", "hex:0:60", ""]
    a, b = windows("A" * 25 + key, 3.8)
    assert got[4] == f"entropy:{a}:{b}"
    assert got[5].startswith("hex:0:80")


def pii_by_regex(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_identifiers():
    rng = random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choice("ab@@..-+%0123456789 ()\né") for _ in range(rng.randint(0, 60)))
        assert detect(t) == pii_by_regex(t), t


def test_disguised_identifiers():
    cases = {
        "mail john.doe [at] example [dot] com now": ("email", "john.doe [at] example [dot] com"),
        "write to jane at example dot org please": ("email", "jane at example dot org"),
        "x ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "jоhn@exаmple.com here": ("email", "jоhn@exаmple.com"),
        "j​ohn@example.com": ("email", "j​ohn@example.com"),
        "plus one two zero two five five five zero one nine nine now": ("phone", "plus one two zero two five five five zero one nine nine"),
        "card four" + " one" * 15 + " ok": ("card", "four" + " one" * 15),
        "eins neun zwei punkt eins sechs acht punkt eins punkt eins": ("ip", "eins neun zwei punkt eins sechs acht punkt eins punkt eins"),
    }
    for text, (kind, part) in cases.items():
        found = [(KINDS[k], text[a:b]) for a, k, b in disguised(text, detect(text))]
        assert found == [(kind, part)], text
    for text in ("meet me at example.com", "un point de vue", "the at sign", "bob@example.com", "one, two, three", ""):
        assert disguised(text, detect(text)) == [], text


def test_pii_rows(docs):
    rows = [(1, "a@b.co é +1 202 555 0143"), (1, "a@b.co é +1 202 555 0143"), (None, None), (3, "a [at] b [dot] co")]
    got = sorted((r.doc_id or 0, r.n_email, r.n_phone, r.spans) for r in scan_pii(docs(rows)).collect())
    twice = (1, 1, 1, "email:0:6,phone:9:24")
    assert got == [(0, 0, 0, ""), twice, twice, (3, 0, 0, "email:0:17")]
    assert scan_pii(docs(rows).limit(0)).count() == 0


def test_pages(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=x>Home</a></ul></nav><div id=main><h2>Title</h2><p>First &amp; second&nbsp;line,\n with text. More, yes.<p>Short."
        '<div class="ad">Buy now, cheap. Really.</div><p>Another paragraph, with commas. <a href=q>link</a><br>tail.</div>'
        "<div class=comments><p>Nice post, thanks. I liked it, really.</div><aside>Side, here.</aside><form>f</form><footer>c</footer>"
    )
    text = "Title\n\nFirst & second line, with text. More, yes.\n\nShort.\n\nAnother paragraph, with commas. link tail."
    assert main_text(page) == text
    for odd in ("", "plain", "<p", "<p>a<b", "</div></p>", "<!-- x", "<script>x", "<div " + "a" * 1000, "<nav>only, menu.</nav>", "<p>" * 3000 + "x"):
        assert "<" not in main_text(odd)
    rows = [(1, "u", page, 1), (1, "u", page, 2), (2, None, None, 3), (None, "v", "<p>Hello, world.</p>", 4)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(frame).collect())
    assert got == [(0, "Hello, world.", 13), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert extract_pages(frame.limit(0)).count() == 0


def test_title_and_lead_before_a_long_body():
    body = [f"Paragraph {i}, with commas, and enough words to be the main text of the page." for i in range(20)]
    inner = "".join(f"<p>{t}</p>" for t in body)
    lead = "A lead, short."
    page = f"<body><article><h1>T</h1><div class=lead><p>{lead}</p></div><div class=body>{inner}</div></article></body>"
    assert main_text(page) == "\n\n".join(["T", lead, *body])
    page = f"<body><main><h1>T</h1><p>{lead}</p><section>{inner}</section></main></body>"
    assert main_text(page) == "\n\n".join(["T", lead, *body])
    page = f"<body><div><h1>T</h1><div>{inner}</div></div></body>"
    assert main_text(page) == "\n\n".join(["T", *body])


def test_names_of_wrappers():
    body = [f"Paragraph {i}, with commas, and enough words to be the main text." for i in range(9)]
    inner = "<h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in body) + '<div class="related-posts"><p>See this, too.</p></div>'
    for name in ("layout has-sidebar", "content-with-sidebar", "post no-comments", "page sticky-header", "search-engines"):
        for page in (f'<div class="{name}"><article>{inner}</article></div>', f'<p>Hi.</p><div id="{name}">{inner}</div>'):
            assert main_text(f"<body>{page}<div class=comments><p>Nice, thanks.</p></div></body>") == "\n\n".join(["Title", *body]), page


def test_shingles_of_whole_texts():
    rng = random.Random(2)
    texts = ["", " \n", "One", "a B c", "A b c D", *(" ".join(rng.choice("ab cd ef Éa 日 x1".split()) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    texts.append("word " * 300_000 + "w" * 1_500_000 + " end of it")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = {}
    for t, s in zip(texts, shingle_sets(pa.array(texts), 4), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        expected = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
        assert len(s) == len(expected)
        assert seen.setdefault(frozenset(expected), s.tobytes()) == s.tobytes()
    assert sum(len(f) - 1 for _, _, f in word_hashes(pa.array(texts))) == len(texts)


def test_identifiers_in_long_runs_of_digits():
    """One pass over a run, whatever follows it; the matches are those of the plain pattern."""
    plain = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789.. a") for _ in range(60)) for _ in range(400)]
    texts += ["1.2.3.4.5.6.7.8", "x" + "0" * 5000 + ".1.2.3", "1" * 300 + ".2.3.4 9.9.9.9"]
    for text in texts:
        want = [m.span() for m in plain.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        assert [(a, b) for a, k, b in detect(text) if k == 1] == want, text
    began = time.perf_counter()
    assert [k for _, k, _ in detect("1" * 2_000_000 + ".")] == []
    assert time.perf_counter() - began < 10
