"""Documents for the tests of the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of thing water house river under light winter garden stone over paper morning".split(),
         "fr": "le la et chose eau maison rivière sous lumière hiver jardin pierre papier matin être".split(),
         "de": "der die und ding wasser haus fluss unter licht winter garten stein über papier morgen".split()}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    out = []
    while n > 0:
        k = min(n, rng.randint(5, 14))
        out.append(" ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "s", "en", "er"]) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(out)


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=0, n=40):
    """Prose of three languages and three sources, with copies, near copies and awkward rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "en", "fr", "de")[i % 4]
        rows.append(row(i, prose(rng, rng.choice([3, 20, 60, 150]), lang), lang, f"s{i % 3}" if i % 7 else None))
    rows.append(row(n, rows[2][1], *rows[2][2:4]))
    rows.append(row(n + 1, rows[3][1] + " Morning.", *rows[3][2:4]))
    words = rows[9][1].split(" ")
    words[len(words) // 2] = "changed"
    rows.append(row(n + 2, " ".join(words), *rows[9][2:4]))
    rows += [row(n + 3, None, None, None), row(n + 4, "", "en", "s1"), row(n + 5, " \n\t\n", "en", ""), row(n + 6, "12 34 -- ??", None, "s0"), row(n + 7, "x", "en", "s2")]
    return rows


#: Columns that collide with names the operators use.
CLASH = {"fingerprint": "a", "fp": 1, "text_": "t", "size": 2, "h": 3, "key": "k", "id": 4, "row": "r", "gone": "g", "digest": "d", "score": 0.5, "label": "l", "n": 9, "taken": 7, "kinds": "x", "component_id": 5}


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})
