import hashlib
import random
import re

from tests.llm.helpers import frame, odd_rows
from tidemark.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
PARTS = [
    "a", "b9", "@", ".", "-", "+", "_", "%", "1", "2", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1111",
    "49927398716", "+1 (017) 555-7713", " ", "\n", "é", "\U0001f600", "10.0.0.1", "x@y.z", "(", ")", "a.b@c-d.e", "tel: ",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[name]()
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["1" * 2000, "a@" + "b." * 2000 + "c", "+1" + " " * 2000, "1." * 2000, "a@b.c " * 300]
    rows = odd_rows() + [(1000 + i, t) for i, t in enumerate(texts)]
    got = pii.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r[0]: r[1] for r in rows}
    for r in got:
        found = base(of[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(found).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in found) for i in range(4)]
        assert set(filter(None, joined(found).split(","))) <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers_and_spare_the_rest(spark):
    rows = [(i, f"note {i} then cellphone: +1 (0{i + 10}) 555-77{i + 10} thanks") for i in range(30)]
    rows += [(100 + i, f"word {i} cellphone: 555-7{i:03d} bye") for i in range(10)]
    rows += [(200 + i, f"the year 19{i + 10} and order 5550{i:03d} were fine") for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    for i in range(10):
        start = len(f"word {i} cellphone: ")
        assert got[100 + i] == f"phone:{start}:{start + 8}"
    assert all(got[200 + i] == "" for i in range(30))


def test_accepted_instances_make_patterns_of_their_own(spark):
    """Seeds -> "cellphone:" -> new values -> "hotline:", which stands beside no seed -> further values."""
    rows = [(i, f"note {i} then cellphone: +1 (0{i + 10}) 555-77{i + 10} thanks") for i in range(30)]
    rows += [(100 + i, f"a{i} cellphone: 555-7{i:03d} b{i}") for i in range(10)]
    rows += [(200 + i, f"c{i} hotline: 555-7{i:03d} d{i}") for i in range(10)]
    rows += [(300 + i, f"e{i} hotline: 555-8{i:03d} f{i}") for i in range(10)]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    for first, word in ((100, "a0 cellphone: "), (200, "c0 hotline: "), (300, "e0 hotline: ")):
        assert all(got[first + i] == f"phone:{len(word)}:{len(word) + 8}" for i in range(10))


def test_empty_table(spark):
    assert pii.personal_data(frame(spark, [])).collect() == []


def test_candidates_of_several_tokens(spark):
    rows = [(i, f"note {i} then cellphone: +1 (0{i + 10}) 555-77{i + 10} thanks") for i in range(30)]
    rows += [(100 + i, f"word {i} cellphone: (743) 555-3{i:03d} bye") for i in range(20)]
    rows += [(200 + i, f"word {i} cellphone: (555-4{i:03d}{')' * 80} bye") for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    for i in range(20):
        start = len(f"word {i} cellphone: ")
        assert got[100 + i] == f"phone:{start}:{start + 14}"
        assert got[200 + i] == f"phone:{start}:{start + 9}"


def test_known_values_are_found_where_the_expression_fails(spark):
    """A base match that runs on into other digits is dropped; the number itself is known from elsewhere."""
    numbers = [f"411111111111{1000 + i}" for i in range(400)]
    numbers = [n for n in numbers if luhn(n)][:30]
    rows = [(i, f"a{i} card {n} now") for i, n in enumerate(numbers)]
    rows += [(100 + i, f"b{i} card {n}x/26 paid") for i, n in enumerate(numbers)]
    rows += [(200 + i, f"c{i} card {n} 12/26 paid") for i, n in enumerate(numbers)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, n in enumerate(numbers):
        start = len(f"c{i} card ")
        assert got[i].n_card == 1 and got[200 + i].n_card == 0
        assert got[200 + i].spans == f"card:{start}:{start + 16}"
