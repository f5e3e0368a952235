"""Fixtures and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    """Invented texts with copies, near copies, shared passages, nulls, blanks and accents."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [say(rng.randint(20, 70)) for _ in range(4)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            t = rng.choice(out)[1]
        elif kind < 0.4 and out and (base := rng.choice(out)[1]):
            words = base.split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = " ".join(words)
        elif kind < 0.6:
            t = say(rng.randint(1, 60)) + " " + rng.choice(passages) + " " + say(rng.randint(0, 40))
        else:
            t = say(rng.randint(0, 200))
        out.append((i, t, "en", f"src{min(int(rng.expovariate(1)), 4)}", len(t)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, "  \n ", "en", "src0", 4), (n + 3, "x" * 3000, "en", "src1", 3000)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, rows):
    """The corpus with extra columns whose names the operators use inside."""
    df = frame(spark, rows)
    for c in ("key", "band", "component", "lo", "n", "score", "rank", "bucket", "length", "blocks", "h", "slot", "Doc", "__doc", "__cuts", "__key", "__id", "__at", "__arrival", "mix_id", "mix_at", "cuts", "place"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df
