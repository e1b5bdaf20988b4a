"""Links of secrets' parts against all pairs, on random layouts."""

import random
import time

from tessellar.llm import secrets

KEY = "Ab3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY"
PARTS = [f"{KEY}", "user = bob", "https://db.example.org/x", "password=hunter22", "token: 0123456789abcdef0123456789abcdef", "AKIA" + "A1B2" * 5, "login=" + "n" * 60, "redis://h/" + "0a1b2c3d" * 6]
GAPS = [" ", " and ", "\n", "\n\n", "\r\n", "\r\n\r\n", "\n\r", " \n \n", "x " * 60, "y " * 119, "z " * 121, "w " * 200]


def _brute(text):
    """Linked parts and their credentials, from every pair."""
    strong, weak = secrets.strong_spans(text), secrets.weak_spans(text)
    parts = strong + [w for w in weak if w[0] != "key" or all(w[2] <= s or e <= w[1] for _, s, e in strong)]
    name = {p: {p} for p in parts}
    linked = set()
    for a in parts:
        for b in parts:
            if (secrets.ROLE[a[0]] == "secret") == (secrets.ROLE[b[0]] == "secret"):
                continue
            lo, hi = sorted((a, b), key=lambda x: x[1])
            same = not secrets.BREAK.search(text, lo[1], hi[1] + 1)
            if same and hi[1] - lo[2] <= secrets.SCOPE:
                linked |= {a, b}
                both = name[a] | name[b]
                for p in both:
                    name[p] = both
    return {(p, frozenset(name[p])) for p in linked} if weak else set()


def test_links_equal_all_pairs():
    g = random.Random(5)
    some = 0
    for _ in range(1500):
        text = "".join(x for _ in range(g.randint(1, 9)) for x in (g.choice(PARTS), g.choice(GAPS)))
        found = secrets.credentials(text, secrets.strong_spans(text), secrets.weak_spans(text))
        groups = {}
        for n, p in found:
            groups.setdefault(n, set()).add(p)
        assert {(p, frozenset(groups[n])) for n, p in found} == _brute(text)
        some += bool(found)
    assert some > 500


def test_a_long_part_reaches_over_shorter_ones():
    text = "token=" + "g" * 30 + "0123456789abcdef01234567" + "g" * 30 + " " + "v " * 50 + "user = bob"
    assert [x[0] for x in secrets.linked(text, secrets.strong_spans(text), secrets.weak_spans(text))] == ["identity"]
    assert secrets.linked(f"user = bob\r\n\r\n{KEY}", [], secrets.weak_spans(f"user = bob\r\n\r\n{KEY}")) == []
    assert len(secrets.linked(f"user = bob\r\n{KEY}", [], secrets.weak_spans(f"user = bob\r\n{KEY}"))) == 2


def test_many_parts_take_linear_time():
    text = "user = bob https://a.b/cde " * 20000 + KEY
    began = time.time()
    found = secrets.credentials(text, secrets.strong_spans(text), secrets.weak_spans(text))
    assert time.time() - began < 5 and {x[0] for _, x in found} == {"identity", "endpoint", "key"}
