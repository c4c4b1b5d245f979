"""Small awkward tables that every operator is run over."""

import random

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, part int, node string, score double, hash long"
SOUNDS = {"en": "th er on an re he in ed nd ha", "de": "sch ein ich ung zu ver be tz ei pf", "es": "ción os ar ado que mente lla rr ez ñ"}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    s = SOUNDS[lang].split()
    return ["".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(n)]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Plain documents, copies, near copies, nulls, blanks, a very long text, ties and repeated rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        out.append((i, " ".join(words(rng, lang, rng.randint(30, 90))), lang))
    base = out[3][1].split()
    out.append((n, out[3][1], "en"))
    for k in range(6):
        w = list(base)
        w[5 * k] = "changed"
        out.append((n + 1 + k, " ".join(w), "en"))
    out += [(n + 10, None, "en"), (n + 11, "", None), (n + 12, " \n\t ", "de"), (n + 13, "12 34 !!", "en"), (n + 14, "one two three", "en"), (n + 15, "one two three", "en")]
    out += [(None, "a text without a number of its own " * 3, "en"), (None, None, None), (n + 16, " ".join(words(rng, "de", 9000)), "de")]
    out += [out[5], out[5], (out[5][0], "another text under the same number " * 4, "en")]
    return [(i, t, la, "src0", len(t) if t else None, "x", 1, None, 0.5, 7) for i, t, la in out]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)
