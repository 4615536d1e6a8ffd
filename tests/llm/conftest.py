import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EN = "the cat and the dog sat on the mat with their friends while it was raining outside of the house"
FR = "le chat et le chien sont assis sur le tapis avec leurs amis pendant qu'il pleut dehors devant la maison"


@pytest.fixture
def make(spark):
    """Documents from texts, or from (doc_id, text, lang, source)."""

    def build(rows, extra=None):
        full = []
        for k, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (k, r, "en", "src0")
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        for name, value in (extra or {}).items():
            df = df.selectExpr("*", f"{value} AS `{name}`")
        return df

    return build


ODD = [None, "", " ", "a", "é" * 40, "\n\n", "x" * 5000, EN, EN, "日本語 テスト 🎉", "123 456"]
