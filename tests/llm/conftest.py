import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, wanted_id long, copy int, kept boolean"
PROSE = "word{0} alpha{0} beta{0} gamma{0} delta{0} epsilon{0} zeta{0} eta{0} theta{0} iota{0} "


def prose(i, n=60):
    """n distinct words, others for another i."""
    return " ".join(f"w{i}x{j}" for j in range(n))


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "h", 5, 1, False) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
