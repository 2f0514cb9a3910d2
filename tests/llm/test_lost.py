from verseframe.llm import encoding


def best(spark, rows):
    counts = spark.createDataFrame(rows, "word string, n long")
    got = encoding.channel_gains(counts, encoding.char_model(counts)).where(f"channel = {len(encoding.CHANNELS) - 1}").collect()
    return {r["word"]: r["reading"] for r in got}


def test_lost_character_keeps_the_intact_ones(spark):
    rows = [("вечер", 900), ("зимой", 5), ("з�мой", 1), ("сне�", 1), ("снег", 2), ("дома", 800), ("��мой", 1), ("雨の夜", 3), ("春の海", 500), ("雨�夜", 1)]
    assert best(spark, rows) == {"з�мой": "зимой", "сне�": "снег", "��мой": "зимой", "雨�夜": "雨の夜"}


def test_lost_character_is_never_read_as_a_garbled_word(spark):
    rows = [("loftΓÇ¥", 7), ("loft”", 90), ("sea”", 90), ("loftâ€�", 1)]
    assert best(spark, rows)["loftâ€�"].startswith("loftâ€")


def test_filling_uses_the_whole_word_and_alphabet(spark):
    letters = [chr(0x4E00 + i) for i in range(300)]
    rows = [(f"{a}ж", 50 + i) for i, a in enumerate(letters)] + [("ыы" * 250 + "�", 1), ("юж�", 1), ("ѣ", 1)]
    got = best(spark, rows)
    assert all("�" not in r for r in got.values()) and len(got) == 2
    assert set(encoding.char_model(spark.createDataFrame(rows, "word string, n long")).alphabet) >= {*letters, "ѣ"}
