"""Small messy tables shared by the operator tests."""

import random
import string

from fleetlens.llm.ship import ship_code

UPPER = string.ascii_uppercase
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Columns whose names clash with names that operators use or return.
CLASHING = ["row", "id", "text_sha256", "n_tokens", "size", "key", "fp", "tag", "group", "rest", "_size", "failed", "n_words", "passes", "c0", "kept", "spans"]


def lower_ascii(text):
    return text.translate({ord(c): c.lower() for c in UPPER})


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in ASCII_SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def messy_texts(seed=7):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "été", "naïve", "日本", "x1", "foo-bar", "the", "of", "#tag", "|", "　wide"]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    long = prose(30_000)
    base = prose(80)
    return [
        None, "", " ", "\n\n", "a", "A", "a ", "Ä", "ä", base, base.upper(), base.lower(), base + " tail", base[:-1], long, long, long + "!", long.swapcase(),
        "one two", "two  spaces\n and\tmore ", "ends in space ", "<|endoftext|> marks <|endoftext|>", "it's we're I'll don't", "x" * 300, "same same same " * 40,
        *[prose(rnd.randint(1, 120)) for _ in range(25)],
    ]


def documents(spark, texts=None, clashing=True):
    """(doc_id, text, lang, source) with null ids, repeated rows and ids, and clashing extra columns."""
    ship_code(spark)
    texts = messy_texts() if texts is None else texts
    rows = [(i, t, "en", [None, "s1", "s2", "S3"][i % 4]) for i, t in enumerate(texts)]
    if texts:
        rows += [(None, texts[-1], "en", "s1"), (None, None, None, None), rows[-1], rows[-1], (3, "another text under a used id", "de", "s1")]
    extra = CLASHING if clashing else []
    schema = "doc_id long, text string, lang string, source string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *[f"{c}-{r[0]}" for c in extra]) for r in rows], schema), rows


def table(df, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
