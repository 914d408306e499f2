import random
import re
import zlib
from collections import Counter

from tests.llm.helpers import frame, rows
from tidemark.llm import spelling_variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(data: list[tuple], one_in: int = 31, least: int = 7, occurrences: int = 2, times: int = 10) -> list[tuple]:
    counts: Counter = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= occurrences}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelt(seed: int) -> list[tuple]:
    """Words with all kinds of edits at all places, doubled letters, accents, capitals, and one prefix that many share."""
    rnd, out = random.Random(seed), []
    letters = "abcdefghäöÄ×"
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 14))) for _ in range(12)] + ["prefixed" + "".join(rnd.choice("ab") for _ in range(4)) for _ in range(12)] + ["aaaaaaaa", "bookkeeper"]
    for i in range(400):
        w = rnd.choice(bases)
        for _ in range(rnd.choice((0, 0, 0, 0, 1, 1, 2))):
            k, c = rnd.randrange(len(w) + 1), rnd.choice(letters)
            w = rnd.choice((w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]))
        out.append((i // 3, rnd.choice(("{0} {0}", "x{1}, {0}-{0}", "{0}一{0}", "{0}")).format(w, w.upper())))
    return out + [(7, bases[0] + " ") for _ in range(100)] + [(7, bases[0] + "a ") for _ in range(9)] + [(None, " ".join(bases) * 2), (None, None), (3, ""), (4, "12 !?")]


def test_forms_roots_and_counts(spark):
    data = misspelt(1)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = brute(data)
    assert found(spelling_variants.spelling_variants(docs, delete_one_in=31)) == want
    assert sum(w[4] for w in want) > 100 and any(w[1] for w in want)


def test_chains_of_forms_end_at_the_root(spark):
    words = [("chained", 1000), ("chainedx", 100), ("chainedxy", 10), ("chainedxyz", 1), ("chainede", 100), ("apartüü", 5)]
    got = found(spelling_variants.spelling_forms(spark.createDataFrame(words, "word string, n long")))
    assert [(w, f, r) for w, f, r, *_ in got] == [("apartüü", None, "apartüü"), ("chained", None, "chained"), ("chainede", "chained", "chained"), ("chainedx", "chained", "chained"), ("chainedxy", "chainedx", "chained"), ("chainedxyz", "chainedxy", "chained")]


def test_odd_rows_clashing_names_and_an_empty_table(spark):
    data = rows()
    assert found(spelling_variants.spelling_variants(frame(spark, data), delete_one_in=3)) == brute([r[:2] for r in data], one_in=3)
    assert found(spelling_variants.spelling_variants(frame(spark, data), least=4)) == brute([r[:2] for r in data], one_in=0, least=4)
    assert spelling_variants.spelling_variants(frame(spark, [])).count() == 0
