import random

import pytest

from corpuscope.llm.registry import prepared


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(llm):
    """Documents from (id, text) or (id, text, lang, source), with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r + (None, None))[:4] if len(r) < 4 else r for r in rows]
        full = [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in full]
        df = llm.createDataFrame(full, SCHEMA)
        extra = ("id", "size", "token", "_part", "label", "start", "score", "n", "print")
        return df.selectExpr("*", *(f"'x' AS `{name}`" for name in extra))

    return make


WORDS = {
    "en": "the of and to in that was with for his they have this from were which their been would there".split(),
    "fr": "les des une dans pour que qui est pas sur avec sont été être cette leurs même très où déjà".split(),
    "de": "der die und das nicht mit eine für auf werden über können größe müssen auch sich wäre dass".split(),
}


@pytest.fixture
def sentence():
    """Made-up text in one of three languages, the same for the same seed."""

    def make(seed, words, lang="en"):
        pick = random.Random(f"{lang}{seed}")
        return " ".join(pick.choice(WORDS[lang]) + pick.choice(["", "", "s", "e", ",", "."]) for _ in range(words))

    return make
