"""License scans with many templates, edited and wrapped in comments, against a plain reading."""

import random
import re

from tessellar.llm import licenses


def _words(text):
    return [w for w in re.split("[\\x00-/:-`{-\\x7f ©‐-‧]+", text.lower()) if w]


def _shingles(text):
    w = _words(text)
    return [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]


def _plain(docs, templates):
    out = set()
    for d, text in docs:
        s = _shingles(text)
        for name, t in templates.items():
            wanted = set(_shingles(t))
            m = len(wanted)
            step = max(1, m // licenses.STEPS)
            best = max((len(wanted.intersection(s[k : k + 2 * m])) for k in range(0, len(s), step)), default=0)
            if m and 5 * best >= 4 * m:
                out.add((d, name, best))
    return out


def test_five_hundred_templates(spark):
    g = random.Random(1)
    vocabulary = [f"term{k}" for k in range(400)]
    templates = {f"t{k}": " ".join(g.choices(vocabulary, k=g.choice([5, 12, 40, 160]))) for k in range(500)}
    names = sorted(templates)
    docs = []
    for d in range(60):
        words = templates[g.choice(names)].split()
        for _ in range(g.randint(0, max(1, len(words) // 40))):
            words.insert(g.randrange(len(words)), "EDIT")
        around = g.choices(vocabulary, k=g.randint(0, 300)), g.choices(vocabulary, k=g.randint(0, 300))
        docs.append((d, " ".join([*around[0], *words, *around[1]])))
    docs += [(100, " ".join(templates[k] for k in names[:60])), (101, ""), (102, "term1 term2")]
    got = {(r.doc_id, r.license, r.shared) for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates=templates).collect()}
    assert got == _plain(docs, templates) and len(got) > 100
    table = spark.createDataFrame(list(templates.items()), "license string, text string")
    assert licenses.scan(spark.createDataFrame(docs[:5], "doc_id bigint, text string"), templates=table).count() == len([x for x in got if x[0] < 5])


def test_header_in_a_comment_and_edited_copies(spark):
    header = licenses.TEMPLATES["apache-2.0-header"].split()
    lines = ["/*", *(" * " + " ".join(header[k : k + 8]) for k in range(0, len(header), 8)), " */"]
    docs = [(0, "\n".join(lines)), (1, "“" + " ".join(header) + "”")]
    for at in range(30):
        words = header[:12] + ["really"] * 3 + header[12:]
        docs.append((10 + at, " ".join(["x"] * at + words)))
    docs.append((99, licenses.TEMPLATES["mit"].upper()))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {d for d, name in got if name == "apache-2.0-header"} == {d for d, _ in docs if d != 99}
    assert {name for d, name in got if d == 99} == {"mit", "mit-grant"}
