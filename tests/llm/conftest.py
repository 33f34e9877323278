import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_Dropped int, epoch string"


def rows(*texts):
    return [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    def make(data):
        return spark.createDataFrame(data, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    line = "a line that many documents share"
    data = rows(None, "", " \n\t", "short", long, f"{line}\nown line number five here", f"{line.upper()}  \nown line number six here", f"{line}\n{line}", "x" * 50_000)
    data += [data[5], data[5], (None, f"{line}\nanother", None, None, None, None, None), (100, "token = abcdefgh12345678", None, None, None, None, None)]
    return frame(data)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
