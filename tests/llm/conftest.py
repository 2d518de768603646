import random

import pytest

SCHEMA = "doc_id bigint, text string, TEXT_HASH string, n_words int, `Kept_Text` string, n_tokens string, fp string, _drops string"


def awkward_texts():
    r = random.Random(7)
    line = "This line of boiler plate is in many documents"
    passage = " ".join(f"leak{i}" for i in range(14))
    texts = [None, "", "", "   ", "\n\n", "one", "one two three four", line, f"  {line.upper()}\t\nown {line}", f"{line}\n{line}\nx", f"a\n{line}", "İstanbul ſ K\x1cz\x85end　漢字かな العربية", "<|endoftext|>x<|endoftext|>", f"before it {passage.upper()} after it", f"{passage} {passage}", "short item", "a short, ITEM! here"]
    texts += ["word " * 30_000, "x" * 20_000, "don't stop'll  twice\t\ttabs\r\n\r\nend "]
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:-1], "changed"]), " ".join(base[1:])]
    alphabet = "ab \n\t\x85　éß漢.,'s9٣"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(60)]
    return texts


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, a repeated row, and columns with clashing names."""
    texts = awkward_texts()
    rows = [(i * 3 - 5, t, "x", 1, "k", "n", "f", None) for i, t in enumerate(texts)]
    rows += [rows[7], (None, texts[7], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
