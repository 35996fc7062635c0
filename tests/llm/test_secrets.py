"""Secret scans: base matches against a plain reading of the contract, decoding by round trips."""

import base64
import gzip
import hashlib
import json
import re
import urllib.parse
import zlib

from lexlab.llm import secrets as S
from tests.conftest import SF_SMALL


def plain(text):
    """The contract's patterns, read literally."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


SECRET = 'password = "hunter2hunter2"'


def wrapped():
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    yield urllib.parse.quote(SECRET, safe="")
    yield "".join(f"\\u{ord(c):04x}" for c in SECRET)
    yield b64(SECRET)
    yield b64(gzip.compress(SECRET.encode()))
    yield b64(zlib.compress(gzip.compress(SECRET.encode())))
    yield b64(urllib.parse.quote(b64(SECRET), safe=""))
    yield urllib.parse.quote(b64(urllib.parse.quote("é" + SECRET)))
    yield urllib.parse.quote(urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""), safe="")


def test_nested_layers_map_to_the_run():
    for code in wrapped():
        text = f"é front {code} tail"
        base, every, layers, refused = S.find(text)
        assert layers >= 1 and refused == 0
        new = set(every) - set(base)
        assert any(k == 0 for _, k, _ in new), code
        lo, hi = text.index(code), text.index(code) + len(code)
        assert all(lo <= s < e <= hi for s, k, e in new if k == 0)


def test_character_spans_of_escapes():
    text = "x %70assword%3Dabcdef%67 y"
    _, every, _, _ = S.find(text)
    assert (2, 0, len(text) - 2) in every
    text = "token=\\u0061bcdef"
    assert (0, 0, len(text)) in S.find(text)[1]


def test_cycles_and_bombs_end():
    text = "%2525" * 50 + "%" * 1000
    assert S.find(text)[2] < 100
    bomb = base64.b64encode(gzip.compress(b"a" * 1_000_000)).decode()
    assert S.find(bomb, max_layer=1000)[3] == 1


def test_table_and_edges(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a" * 300_000 + " token: abcdef "), (None, SECRET),
                                   (-4, "AKIA" + "B" * 16), (-4, "AKIA" + "B" * 16), (-5, "ToKen='ſecret=abcdefg'")],
                                  "doc_id long, text string")
    src = docs.select("doc_id", "text").union(extra).selectExpr("*", "1 AS spans", "2 AS base")
    want = sorted(((d["doc_id"], S.joined(plain(d["text"] or ""))) for d in src.collect()), key=repr)
    rows = S.scan_documents(src).collect()
    assert sorted(((r["doc_id"], r["base"]) for r in rows), key=repr) == want
    for r in rows:
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(list(filter(None, r["base"].split(","))))
    assert S.scan_documents(src.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256) s").collect()[0]["s"]
    assert json.dumps(S.joined([]))


def test_base64_beside_words_and_over_lines():
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    url = lambda x: base64.urlsafe_b64encode(x.encode()).decode()
    packed = gzip.compress(SECRET.encode())
    values = [b64("password=hunter2222"), b64("password=hunter2222").rstrip("="), b64(">>>???>>>password=hunter2222"),
              url(">>>???>>>password=hunter2222"), b64(packed), b64(zlib.compress(SECRET.encode())).rstrip("=")]
    for value in values:
        for front in ("https://h.example/cb/", "see/", "id_", "a-", "ab+", "data:text/plain;base64,", "éé /", "-----", "a/b/c/"):
            for tail in ("", " tail", "-tail", "/x/y", "_"):
                text = f"front {front}{value}{tail}"
                lo, hi = text.index(value), text.index(value) + len(value)
                hits = [(s, e) for s, k, e in S.find(text)[1] if k == 0]
                assert any(s < hi and e > lo for s, e in hits), text
                assert all(text[s:e].split() and " " not in text[s:e] for s, e in hits)
    for columns in (64, 76):
        for cut in ("\n", "\r\n", "\n  "):
            for filler in range(30, 70):
                body = "z" * filler + " password=hunter2222 é " + "y" * 100
                lines = re.findall(f".{{1,{columns}}}", b64(body))
                text = "front\n\n" + cut.join(lines) + "\n\ntail"
                at, where = 7, []
                for x in lines:
                    where.append((at, at + len(x)))
                    at += len(x) + len(cut)
                p = body.encode().index(b"password")
                q = p + len("password=hunter2222") - 1
                first, last = (p // 3 * 4 + p % 3) // columns, (q // 3 * 4 + q % 3 + 1) // columns
                assert (where[first][0], 0, where[last][1]) in S.find(text)[1], (columns, filler)
            noise = hashlib.sha512(b"n").hexdigest() * 3
            lines = re.findall(f".{{1,{columns}}}", b64(gzip.compress((noise + "\n" + SECRET).encode())))
            found = S.find("front " + cut.join(lines) + " tail")
            assert any(k == 0 for _, k, _ in found[1]) and found[3] == 0
    prose = "one plain-word_list of/path/names and https://www.example.org/some/longer/path_name-here\nnext/line/of/words/again"
    assert S.find(prose)[1] == S.scan(prose)


def test_large_streams_and_further_members():
    noise = "".join(hashlib.sha256(str(i).encode()).hexdigest()[:9] + "é " for i in range(3000))
    b64 = lambda x: base64.b64encode(x).decode()
    deep = "%70assword=abcdefg " + b64(gzip.compress(b"AKIA" + b"B" * 16))
    for where in (0, 997, 1000, 5001, len(noise)):
        body = (noise[:where] + " " + SECRET + " " + deep + " " + noise[where:]).encode()
        for data in (gzip.compress(body), zlib.compress(body), zlib.compress(gzip.compress(body)), gzip.compress(gzip.compress(b"one") + gzip.compress(body))):
            base, every, layers, large = S.find(f"x {b64(data)} y", max_layer=2000)
            assert {k for _, k, _ in set(every) - set(base)} >= {0, 1} and large >= 1, where
            assert (2, 0, 2 + len(b64(data))) in every
    members = b64(gzip.compress(b"first member") + gzip.compress(SECRET.encode()))
    assert (0, 0, len(members)) in S.find(members)[1] and S.find(members)[3] == 0


def test_long_nested_escapes_take_linear_time():
    import time
    for run in ("%" + "25" * 500_000 + "41", "%2541" * 200_000, "\\" + "u005c" * 200_000 + "u0041"):
        began = time.process_time()
        S.find(run)
        assert time.process_time() - began < 10
    text = "see %252525" + "70%2561ssword%25253Dhunter2222"  # %70 is p, %61 is a, %3D is =
    base, every, *_ = S.find(text)
    assert not base and (text.index("%"), 0, len(text)) in every
    text = "x \\u005cu0070assword=hunter3333"
    assert (2, 0, len(text)) in S.find(text)[1]


def test_equal_large_runs_keep_their_own_spans():
    import base64
    import zlib
    packed = base64.b64encode(zlib.compress(("filler words " * 400 + " password=hunter2222 " + "more words " * 400).encode())).decode()
    text = f"a {packed} b {packed} c"
    spans = [(text.index(packed), 0, text.index(packed) + len(packed)), (text.rindex(packed), 0, text.rindex(packed) + len(packed))]
    for most in (S.MAX_LAYER, 2000):
        got = [x for x in S.find(text, most)[1] if x[1] == 0]
        assert [(s, e) for s, _, e in got] == [(s, e) for s, _, e in spans], most
