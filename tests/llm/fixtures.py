"""Small documents with all that the operators must bear."""

from __future__ import annotations

import random

#: Names that operators use inside, as columns of strings.
CLASHING = """often n at windows lead block found root size centre links i j chunk key _n _u _c _t _take _h _order _slice piece batch slot y r x held
part segment sizes freq payload media pcm _domain_ batch_ leaf rank score predicted class_id n_links _class band bands grams""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string, _k1 string, node int, _copies int, bucket int, " + ", ".join(f"{c} string" for c in CLASHING)
SYLLABLES = ["th", "er", "on", "an", "re", "ti", "é", "ou", "st", "Ö"]


def word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def prose(rng: random.Random, n: int) -> str:
    return "".join(word(rng) + rng.choice([" ", " ", " ", "\n", ".\n", ", "]) for _ in range(n)).strip()


def texts(seed: int = 1) -> list[str | None]:
    """Prose, exact and near copies, shared passages, repeated words, empty, null, odd white space, a very long one."""
    rng = random.Random(seed)
    out: list[str | None] = [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    base = prose(rng, 150)
    out += [base] * 6
    for i in range(8):
        words = base.split(" ")
        for _ in range(i):
            words[rng.randrange(len(words))] = word(rng)
        out.append(" ".join(words))
    passage = prose(rng, 60)
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 30)}" for _ in range(5)]
    out += [f"{passage}\n{passage}", "same " * 90, "a b c d", "a b c d", "a b c e", "a b c d e f"]
    out += ["", "", None, None, " \t\n ", "\x0bx\x0c y\x0d\x0az", " nbsp word em", "ΑΒΓ 日本 語 🙂🙂", "x" * 3000]
    out.append(prose(rng, 6000))
    return out


def rows(seed: int = 1) -> list[tuple]:
    found = []
    for i, t in enumerate(texts(seed)):
        source = "src0" if i % 3 == 0 else None if i == 7 else f"src{i % 5}"
        found.append((i, t, None if i == 9 else ["en", "fr", "de"][i % 3], source, None if t is None else len(t), "c", "c", "c", 1, 2, 3, *[None] * len(CLASHING)))
    found.append(found[3])  # a repeated row
    return found


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
