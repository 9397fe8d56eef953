import hashlib
import re

from pyspark.sql import functions as F

from strideframe.llm import personal


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def brute(text):
    """kind:start:end of all base spans."""
    found = {
        "email": re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        "ip": (m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))),
        "card": (m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15),
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, all_ in found.items() for m in all_)


TRICKY = [
    "a@b.c_d@e.f x@@y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000255.1.1.1 99999999999999.1.1.1", "", None,
    "4111 1111 1111 1111-1 4111-1111-1111-1111 5 +1 (499) 555-6503. +12 3", "éé\U0001F600 4111111111111111 +44 20 7946 0958)", "1." * 300, "9" * 5000,
    "1 " * 5000, "a.b@c.d " * 400, "1.2.3.4 " * 300, "+123456789 ((+1--2345678901234567890", "a" * 20000, "me@x.y.", "@@@@", "%+-@a-.b-",
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in personal.personal_spans(docs).select("doc_id", personal.as_text(F.col("base")).alias("s")).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(TRICKY)}


def test_contexts_discover_unseen_identifiers(spark):
    """Cards after "card number" are known; a mistyped one there is found, the same shape elsewhere isn't."""
    good = ["4111111111111111", "5500000000000004", "4012888888881881", "378282246310005", "6011000990139424"]
    rows = [(i, f"please charge card number {n} for order {i} today") for i, n in enumerate(good)]
    rows += [(10, "please charge card number 4111111111111112 for this"), (11, "serial of part 4111111111111113 in stock"), (12, "card number unknown")]
    found = personal.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in found.select("doc_id", personal.as_text(F.col("added")).alias("s")).collect()}
    assert got[10] == "card:26:42" and not any(v for k, v in got.items() if k != 10)
    red = {r.doc_id: r.text for r in personal.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert red[10] == "please charge card number [card] for this" and red[11] == rows[6][1]


def planted():
    """Texts with seeds and unseen identifiers in telling contexts, and the same shapes in other ones: (texts, wanted spans)."""
    import random

    draw = random.Random(5)
    texts, wanted = [], {}

    def card(valid):
        while True:
            n = "4" + "".join(draw.choice("0123456789") for _ in range(15))
            if luhn(n) == valid:
                return n

    def put(lead, instance, tail, kind=None):
        if kind:
            wanted[len(texts)] = {f"{kind}:{len(lead)}:{len(lead) + len(instance)}"}
        texts.append(lead + instance + tail)

    lead = ["we charged card number ", "his card number: ", "(card number) "]
    for i in range(60):
        word = f"n{draw.choice('abcdefgh')}{draw.choice('abcdefgh')}"
        put(lead[i % 3], card(True), f" {word} as agreed")
        put(f"dial {word} on phone ", f"+44 20 7946 {draw.randrange(1000, 9999)}", f" {word} today")
        put("write to ", f"{word}{i}@host{i}.example.org", " for more")
        put("log from tel:", f"+1 {draw.randrange(200, 999)} 555 {draw.randrange(1000, 9999)}", f" {word}")
        if i % 3 == 0:
            put(lead[i % 2], card(False), f" {word} refused", "card")
            put("their phone: ", f"020 7946 {draw.randrange(1000, 9999)}", f" {word}", "phone")
            put("please write to ", f"{word} at host{i} dot org", f", {word}", "email")
            put("see tel:", f"{draw.randrange(200, 999)}-555-{draw.randrange(1000, 9999)}", f" {word}", "phone")
        put(f"{word} serial ", card(False), " in stock")
        put(f"{word} lot ", f"020 7946 {draw.randrange(1000, 9999)}", " in stock")
        put(f"{word} stood ", f"{word} at home{i} dot matrix", " printer")
    return texts, wanted


def test_planted_identifiers_are_found(spark):
    texts, wanted = planted()
    found = personal.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = found.select("doc_id", personal.as_text(F.col("base")).alias("b"), personal.as_text(F.col("added")).alias("a")).collect()
    assert all(r.b == brute(texts[r.doc_id]) for r in rows)
    got = {(r.doc_id, x) for r in rows for x in r.a.split(",") if x}
    want = {(d, x) for d, xs in wanted.items() for x in xs}
    assert len(got & want) > 0.9 * len(want) and len(got & want) > 0.9 * len(got)


def test_graph_scoring_is_that_of_brute_force(spark):
    """Patterns and instances at random, scored in plain Python until nothing changes."""
    import math
    import random

    draw = random.Random(9)
    numbers = [f"41111111111{k:05d}" for k in range(400)]
    seen = [n for n in numbers if luhn(n)][:30]
    insts = [(n, 2) for n in seen] + [(n, None) for n in numbers if not luhn(n)][:20] + [("12", None), ("7 up", None)]
    edges = [(f"p{draw.randrange(4 if kind else 12)}", x, kind) for x, kind in insts for _ in range(3)]
    found = spark.createDataFrame([([p], x, k) for p, x, k in edges], "patterns array<string>, inst string, kind int")
    got = {(r.inst, r.kind) for r in personal.discover(found).collect()}

    graph, known = set(edges), {x: 1.0 for x, k in insts if k is not None}
    held = {p: {x for q, x, _ in graph if q == p} for p, _, _ in graph}
    scores, unseen = dict(known), {}
    for _ in range(personal.ROUNDS):
        worth = {}
        for p, xs in held.items():
            if sum(scores.get(x, 0) >= 0.5 for x in xs) >= personal.MIN_SEEDS:
                worth[p] = sum(scores.get(x, 0) for x in xs) / (len(xs) + personal.SMOOTHING)
        worth = {p: w for p, w in worth.items() if w >= personal.MIN_WORTH}
        new = {}
        for x, k in insts:
            mine = [min(worth[p], 0.99) for p, y, _ in graph if y == x and p in worth]
            if k is None and mine and re.match(personal.SHAPES["card"], x):
                new[x] = 1 - math.prod(1 - w for w in mine)
        if new == unseen:
            break
        unseen, scores = new, known | new
    assert got == {(x, 2) for x, s in unseen.items() if s >= personal.MIN_SCORE} and got


def test_odd_rows(spark, odd):
    found = personal.personal_spans(odd).collect()
    assert len(found) == 10 and not any(r.base or r.added for r in found)
    assert personal.personal_spans(odd.limit(0)).count() == 0


def test_query_on_documents(spark, rows):
    from strideframe.llm.queries import QUERIES

    got = QUERIES["op3_pii"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id][0] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in personal.KINDS]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
