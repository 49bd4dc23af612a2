"""Words and lines in the patterns that select a corpus."""

from fathom.sources import corpus


def test_words_are_ascii_and_lines_end_at_newlines(spark):
    texts = {1: "The été, complétion", 2: "The nation", 3: "x\nThe ètion", 4: "x\rThe a tion", 5: "The a\u2028b tion", 6: "The a\nb tion", 7: "Theé tion", 8: "Then tion", 9: None, 10: "x\u0085The a tion", 11: "a\nThe x\r-tion"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus.select_corpus(docs, r"(?m)^The\b.*\btion", text="text").collect()}
    assert got == {1, 3, 5, 7, 11}
    assert {r.doc_id for r in corpus.select_corpus(docs, r"The\B|\\\\b", text="text").collect()} == {8}
