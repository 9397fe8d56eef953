import hashlib
import random
import string
import uuid

import regex

from strideframe.llm import queries, secret_scan

NAMES = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def brute(text):
    """Base spans with another engine and explicit letter classes."""
    text = text or ""
    either = "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in "password|passwd|secret|token|api_?key")
    assign = regex.compile(rf"""(?:{either})["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in regex.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in regex.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert len(rows) == len(texts)
    return [([tuple(s) for s in rows[i].base], [tuple(s) for s in rows[i].spans]) for i in range(len(texts))]


def added(pair):
    return [(s, e) for s, _, kind, e in pair[1] if kind == secret_scan.ADDED]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["token", "TOKEN", "api_key", "apikey", "Secret", "passwd", "password", '"', "'", " ", "  ", "=", ":", "\n", "é", "😀", "AKIA", "ſecret", "toKen",
             "abc", "ab12cd", "0123456789abcdef01234567", "ABCDEFGHIJ0123456789", "x.y-z", "f" * 23]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "tokentoken=abcdef", "token=abc token = abcdefg", "AKIA" + "A" * 15, "AKIAAKIA" + "0" * 12, "a" * 200_000 + " token: " + "q" * 100_000]
    for text, (base, spans) in zip(texts, scanned(spark, texts), strict=True):
        assert base == brute(text)
        assert set(base) <= set(spans) and spans == sorted(spans)


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(7)

    def draw(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"]
    secrets = [draw(a, n) for a in alphabets for n in (24, 32, 44) for _ in range(40)]
    secrets = [s.strip("+/") for s in secrets]
    found = scanned(spark, [f"The é value is {s}, kept.\nNothing else" for s in secrets])
    hit = [added(f) == [(15, 15 + len(s))] or bool(f[0]) for s, f in zip(secrets, found, strict=True)]
    assert sum(hit) >= 0.99 * len(secrets)
    words = [
        "getElementsByTagNameNS", "AbstractSingletonProxyFactoryBean", "/usr/local/lib/python3/site-packages", "internationalization", "the-quick-brown-fox-jumps",
        "MAX_NUMBER_OF_CONNECTIONS", "text_column_name_v2_final", "Donaudampfschifffahrtsgesellschaft", "https://example.com/articles/spring-in-the-mountains.html",
        "=" * 60, "-" * 80, "a" * 50, "thisisaverylongwordwithoutanyspaces",
    ]
    assert [added(f) for f in scanned(spark, words)] == [[] for _ in words]


def test_known_digests_and_identifiers_are_left_out(spark):
    digests = [hashlib.new(name, b"x").hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")]
    known = [d.upper() for d in digests] + ["sha256-YmFzZTY0IGhhc2ggb2YgYSBmaWxlIG9mIHRoZSBzaXRlMDE=", str(uuid.UUID(int=2**127 - 12345)).upper(),
             "2024-01-02T03-04-05Z", "4929348385146306123456", "ISBN-978-3-16-148410-0-11", "data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4"]
    assert [added(f) for f in scanned(spark, known)] == [[] for _ in known]
    token = "wJalrXUtnFEMI+K7MDENG+bPxRfiCYzQ81"
    assert added(scanned(spark, [f"key {token}"])[0]) == [(4, 4 + len(token))]
    assert added(scanned(spark, [f"token={token}"])[0]) == []  # inside a base span
    assert added(scanned(spark, [f"ü{token} {token}ü"])[0]) == []  # part of a longer word


def test_query_over_the_small_table(spark, rows):
    found = {r.doc_id: r for r in queries.op13_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == rows.keys()
    for d, (text, _, _) in rows.items():
        base = brute(text)
        r = found[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[2] == k for b in base) for k in secret_scan.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
        spans = [(int(s), NAMES[k], k, int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and set(base) <= set(spans) and len(spans) == len(base) + r.n_added


def test_odd_rows_and_empty_table(spark, odd):
    found = secret_scan.scan(odd.selectExpr("*", "1 as base", "2 as spans")).collect()
    assert len(found) == odd.count() and all(r.base == [] and r.spans == [] for r in found)
    assert secret_scan.scan(odd.limit(0)).count() == 0
