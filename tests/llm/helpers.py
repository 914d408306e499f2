import random

#: Names that operators use inside.
CLASHING = ("row", "n", "fp", "h", "count", "id", "start", "kept", "a", "b", "key", "queue", "at", "range", "train_", "spans", "word", "block", "_sha", "_n", "_row", "_copy", "_times", "_drawn", "_id", "_text", "_h", "d", "k", "s", "t", "sha", "m", "cut", "cuts", "place", "copies", "size")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
WORDS = {"en": "the of and to in house tree river night water stone light great small".split(), "de": "der und die nicht über straße häuser wald groß nacht wasser stein".split()}


def sentence(rnd: random.Random, lang: str, n: int) -> str:
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Ordinary texts, exact and near copies, null and empty and very long ones, nulls in every column, repeated rows."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(["en", "de"])
        out.append((i, sentence(rnd, lang, rnd.randint(3, 200)), lang, "big" if rnd.random() < 0.5 else f"s{i % 3}"))
    out += [(n, out[0][1], "en", "big"), (n + 1, out[0][1], None, None), (n + 2, out[1][1] + " extra", "en", "s1"), (n + 3, None, "en", "s1"), (n + 4, "", None, "s1"), (n + 5, "", "de", None)]
    out += [(n + 6, sentence(rnd, "en", 20_000), "en", "s2"), (n + 7, " \t\n ", "en", "s2"), (n + 8, "12 34 !?", "en", "s2"), (n + 9, "x" * 50_000, None, "s0")]
    out += [out[2], out[2], (n + 10, out[5][1], "de", "s0"), (n + 11, "ÄÖÜ ß é́ 日本 <|endoftext|> it's", "de", "s1")]
    return [(*r, None if r[1] is None else len(r[1]), *([None if i % 2 else f"x{i}"] * len(CLASHING))) for i, r in enumerate(out)]


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
