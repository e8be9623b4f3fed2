import random
import re

from pyspark.sql import functions as F

from kvlake.llm import license_scan as L


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text):
    w = words(text)
    places, base, own, score, best = [], set(), set(), 0.0, (0, 0.0)
    for p, label in L.PHRASES.items():
        k = p.split()
        for i in range(len(w)):
            if w[i : i + len(k)] == k:
                places.append(i)
                base.add(label)
                score = 1.0
    for t in L.TEMPLATES:
        for start in range(-len(t.words), len(w)):
            fit = [0 <= start + m < len(w) and w[start + m] == t.words[m] for m in range(len(t.words))]
            if all(fit[m] for m in t.mandatory):
                own.add(t.label)
                score = max(score, sum(fit) / len(fit))
                best = max(best, (sum(fit), sum(fit) / len(fit)))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score, best[1]


def test_scan(spark):
    rnd = random.Random(3)
    parts = ["Licensed under CC BY-NC 4.0.", "CC BY", "cc", "by", "General Public License", "All rights\nreserved", "GNU General Public License, version 3", "the MIT License", "été", "LİCENSE", "K", "x", "Apache License, Version 2.0"]
    parts += [t.text for t in L.TEMPLATES] + [t.text[:-4] for t in L.TEMPLATES]
    texts = [None, "", " .!", "by", "Apache License, Version 2.0", "cc by " * 5000, "z" * 100_000]
    texts += [" ".join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(150)]
    texts += texts[7:12]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, labels int")
    got = L.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id])
    assert L.scan(df.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("all rights reserved").alias("text"))
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_edited_licences(spark):
    """A changed word lowers the coverage, a changed key phrase ends it; the rest of the
    index words tell nothing alone."""
    mit = next(t for t in L.TEMPLATES if t.label == "mit" and len(t.words) > 100)
    rare = L.rare_words(L.TEMPLATES)[L.TEMPLATES.index(mit)]
    free = next(i for i in range(len(mit.words)) if i not in mit.mandatory)
    plain, key, head = list(mit.words), list(mit.words), ["x"] * 7
    plain[free], key[rare[0]] = "changed", "changed"
    texts = [mit.text, " ".join(head + plain), " ".join(key), " ".join(mit.words[i] for i in rare), " ".join(mit.words[: mit.mandatory[-1] + 1]), f"{mit.text} {mit.text}"]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k])[1:] == brute(t)
    n = len(mit.words)
    assert got[0].coverage == got[5].coverage == 1 and got[1].coverage == (n - 1) / n and "mit" in got[1].labels
    assert got[3].labels == "" and 0 < got[4].coverage < 1


def test_every_template_has_its_index_words():
    for t, places in zip(L.TEMPLATES, L.rare_words(L.TEMPLATES)):
        assert places and set(places) <= set(t.mandatory) and all(t.mandatory[0] <= i <= t.mandatory[-1] for i in places)
        assert tuple(brute(t.text))[-1] == 1 and t.label in brute(t.text)[5].split(",")
