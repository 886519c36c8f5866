"""Small documents with the cases that every operator must stand: nulls, empty, long, repeated rows, clashing names."""

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit string, _th string, span string, label string"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


def edited(rng, t, share):
    return " ".join(w if rng.random() > share else rng.choice(WORDS) + "x" for w in t.split(" "))


def rows(seed=3):
    rng = random.Random(seed)
    base = text(rng, 120)
    shared = text(rng, 60)
    long = text(rng, 9000)
    out = [base, base, edited(rng, base, 0.02), edited(rng, base, 0.06), edited(rng, base, 0.2), "", None, " \n\t ", "one", "one two", "one two", "Ünï cödé ß " * 9, long, long + " tail", text(rng, 40) + " " + shared + " " + text(rng, 30), shared + " " + text(rng, 20)]
    out += [text(rng, rng.randrange(1, 200)) for _ in range(25)]
    out += [edited(rng, out[-1], 0.03) for _ in range(6)]
    made = [(i * 3, t) for i, t in enumerate(out)]
    made += [made[0], made[2], (0, "other text of a repeated id"), (None, base), (None, None)]
    return [(i, t, "en", None, None, "u", "h", "s", "l") for i, t in made]


def docs(spark, seed=3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
