import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size string, shard string, key string, kept string, weight string, value string, label string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(spark, texts):
    """documents with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) + ("x",) * 8 for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ','])}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


EDGES = [None, "", "   \n\t", "one", "one two three", "ñandú — 漢字 😀", "A" * 50_000, "a " * 30_000, "x\x0by\x0cz"]


def mixed(seed=1, base=12):
    """Copies, near copies, shared passages and edge cases, as (doc_id, text)."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 200), 2000) for _ in range(base)]
    shared = prose(rng, 80, 5000)
    texts += [texts[0], texts[0], texts[1] + "\n", edited(rng, texts[2], 0.02), edited(rng, texts[2], 0.05), edited(rng, texts[3], 0.3)]
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(4)] + [shared + " " + shared, shared]
    texts += EDGES
    rng.shuffle(texts)
    return list(enumerate(texts))
