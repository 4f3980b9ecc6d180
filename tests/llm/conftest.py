import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, score string, pid string, pieces string, train string"


def corpus(n=120, seed=5):
    """Texts of invented words: copies, near copies, shared passages, long, short, empty and null ones."""
    rng = random.Random(seed)
    syllables = {"en": ["the", "and", "ing", "er", "sh", "ou"], "de": ["der", "sch", "ung", "zu", "ä", "ie"], "fr": ["le", "é", "eau", "ou", "ç", "ion"], "es": ["la", "ción", "ñ", "os", "ado", "rr"]}
    word = lambda s: "".join(rng.choices(s, k=rng.randint(1, 3)))
    shared = " ".join(word(syllables["en"]) for _ in range(60))
    texts = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        words = [word(syllables[lang]) for _ in range(rng.choice([3, 6, 30, 80, 150]))]
        words[0] = words[0].capitalize()
        if i % 9 == 0:
            words[len(words) // 2 : len(words) // 2] = shared.split()
        text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "  "]) for w in words).strip()
        if texts and i % 11 == 0:
            text, lang = texts[rng.randrange(len(texts))]
        elif texts and i % 7 == 0:
            text, lang = texts[rng.randrange(len(texts))]
            w = text.split()
            if w:
                w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        texts.append((text, lang))
    return texts


def rows_of(texts):
    out = [(i * 3 + 1, t, lang, f"src{i % 3}", len(t), "clash", "clash", "clash", "clash") for i, (t, lang) in enumerate(texts)]
    long = " ".join(f"w{i * i % 997}" for i in range(8000))
    out += [(9001, None, None, None, None, None, None, None, None), (9002, "", "en", "s", 0, None, None, None, None), (9003, "  \n\t ", None, "s", 5, None, None, None, None)]
    out += [(9004, long, "en", "s", len(long), None, None, None, None), (9005, "?? 12 .", None, "s", 7, None, None, None, None), (9006, long[:30000] + " end", "en", "s", 1, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def documents(spark):
    """(frame, rows): documents with clashing extra columns and every odd kind of text."""
    rows = rows_of(corpus())
    return spark.createDataFrame(rows, DDL).repartition(5), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows and rows without doc_id."""
    rows = [(7, "a b c d e f g h", "en", "s", 1, None, None, None, None)] * 3 + [(None, "a b c d e f g h", "en", "s", 1, None, None, None, None)] * 2 + [(8, None, None, None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, DDL)
