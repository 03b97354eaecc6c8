"""places of words are found for matches only, from what stands before them."""

from pyspark.sql import functions as F

from letterspark.operators import claim_phrases as W


def test_only_words_that_begin_a_pattern_leave_a_window(spark):
    text = "  ΣΑΣ İxé  " + "nothing here \t\n" * 150 + "Verify\n your   mailbox, 17 days ago"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "verify your account")], "doc_id long, text string")
    patterns = (("p", "a", "verif* ..2 your ..2 mailbox|account", 0.9), ("q", "b", "# days", 0.6))
    found = W.match_phrases(df, patterns=patterns)
    got = {(r.doc_id, r.pattern): (text if r.doc_id == 1 else "verify your account")[r.start : r.end] for r in found.collect()}
    assert got == {(1, "p"): "Verify\n your   mailbox", (1, "q"): "17 days", (4, "p"): "verify your account"}
    # places of all words were made for every window, by a step that copied them for each word
    each = W.windows(df, "text", "doc_id", 8)
    assert "_s" not in each.columns
    assert each.select(F.sum(F.least(F.size("_w"), F.lit(W.WINDOW)))).first()[0] == len([1 for _ in text.split()]) + 1 + 3
