"""Small tables with the awkward cases every operator must bear."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash int, word string"


def awkward():
    """Null, empty and blank texts, ties, repeated rows, a long text, odd white space, extra columns."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "δέλτα", "epsilon", "zeta", "eta", "θ", "été", "kappa", "lambda", "mu"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    base = prose(80)
    texts = [None, "", "   \n\t ", "one", "one two three", base, base, base.upper(), base + " tail", base.replace(" ", "\x0b", 3),
             "a b a b a b a b", "x\x85y\x1cz x\x85y\x1cz", prose(30000), "line one\n\nline one\n  \nline two\nline one ", "*** ### $$$ " * 20,
             prose(60) + "\n" + prose(60), "\n".join([prose(9)] * 12), "w" * 50000]
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, i, "w") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[6]]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)
