"""Small tables with the awkward rows that every operator must take."""

import random

SCHEMA = "lang string, doc_id long, text string, score string, shard string, n_words string"
WORDS = "the of and stone river light glass road quiet seven under paper north and sails idiot".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, extra=()):
    """Copies, near copies, shared passages, nulls, empties, white space, a long text, repeated and null ids."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [base, base, near, prose(3, 200) + " " + passage, passage + "\n" + prose(4, 90), prose(5, 30) + passage, None, None, "", "   \n\t ", "one", "One two three",
             prose(6, 9000), "é ü  double  space \n end ", "a\u00a0b \u2003c\x1cd #tag <|endoftext|>", (prose(7, 40) + " ") * 3, base.upper(), "x\n \ny", "tail  ", "  head"]
    rows = [("en", i, t, "s", "k", "w") for i, t in enumerate(texts)]
    rows += [("en", 3, prose(8, 50), "s", None, "w"), ("en", None, prose(9, 50), None, "k", "w"), ("de", None, None, "s", "k", None), *extra]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda x: tuple((v is not None, v) for v in x))
