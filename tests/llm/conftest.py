import hashlib
import random
import re
import string

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
# Names the operators use inside; none of them may disturb a result.
CLASH = ("h", "g", "tid", "pos", "keep", "hits", "key", "part", "rng", "block", "bucket", "payload", "size", "copy")


@pytest.fixture(scope="session")
def docs_of(spark):
    """``documents``-like table from (id, text) pairs, with extra columns of clashing names."""
    def build(pairs, langs=None, clash=True):
        rows = [(i, t, langs[k] if langs else "en", "s", len(t) if t is not None else None)
                for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            for name in CLASH:
                df = df.selectExpr("*", f"cast(null as string) as `{name}`")
        return df.repartition(3) if rows else df

    return build


@pytest.fixture(scope="session")
def corpus():
    """Small corpus with exact copies, near copies, shared passages, repeats inside a text, ties, nulls,
    empty and long texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, base = prose(70), prose(160)
    pairs = [(i, prose(rng.randint(1, 200))) for i in range(10, 40)]
    pairs += [(50 + i, base) for i in range(12)]
    for i in range(15):
        words = base.split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 5))
        pairs.append((70 + i, " ".join(words)))
    pairs += [(100 + i, prose(30) + "\n" + passage + "\n" + prose(20)) for i in range(14)]
    pairs += [(120, passage + " " + passage), (121, "be " * 300), (122, None), (123, ""), (124, "  \t\n"),
              (125, prose(4000)), (126, "Ünï çödé " * 30), (127, "Ünï çödé " * 31), (None, passage), (None, None),
              (128, base.upper()), (129, base.replace(" ", "  "))]
    return pairs


@pytest.fixture(scope="session")
def sha():
    return lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
