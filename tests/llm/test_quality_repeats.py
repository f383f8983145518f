from quillspark.llm import quality


def test_rare_repeats_are_judged_by_their_group(spark):
    """15 % of the words in repeated windows, below the base rule, where no other text has any."""
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(100)), "en", "a") for i in range(60)]
    head = " ".join(f"v{j}" for j in range(8))
    rows.append((900, " ".join([head, *(f"u{j}" for j in range(84)), head]), "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[900].n_repeat_words == 16 and got[900].n_words == 100 and not got[900].base_failed
    assert [d for d, r in got.items() if not r.kept] == [900]
