from pyspark.sql import functions as F
from tilewright.llm import licences

TEXTS = {
    1: (None, []), 2: ("", []), 3: ("Just prose.\nAnd more of it, without any licence at all.", []),
    4: ("Intro.\nReleased under the MIT License.", ["MIT"]), 5: ("Licensed under the Apache License, Version 2.0.\nx", ["Apache"]),
    6: ("LICENSED UNDER CC BY-NC 4.0.", ["CC"]), 7: ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", ["GPL", "MIT"]),
    8: ("a\n" * 50_000 + "// Redistribution and use in source and binary forms, with or without modification, are permitted provided that", ["BSD"]),
    9: ("The copy was made without his knowledge, otherwise nothing happened.", []),
}


def test_families(spark):
    rows = [(k, t, "x") for k, (t, _) in TEXTS.items()] + [(4, TEXTS[4][0], "x"), (None, TEXTS[5][0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = licences.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.licences == (["Apache"] if r.id is None else TEXTS[r.id][1]), r
    unknown = spark.createDataFrame([(1, "Distributed under the Artistic License.")], "doc_id long, text string")
    assert licences.scan(unknown).first().licences == ["unknown"]
    assert licences.scan(docs.limit(0)).count() == 0


def test_lines_without_a_marker_are_classified(spark):
    texts = {
        1: ("Released under the MIT licence", {"MIT"}), 2: ("modification, are permitted provided that the following conditions are met:", {"BSD", "unknown"}),
        4: ("Er ging mit dem Hund nach Hause.", set()),
        5: ("Im Zug saß er mit dem Hund, " * 3000, set()),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    for r in licences.scan(docs).collect():
        want = texts[r.id][1]
        assert set(r.licences) <= want and bool(r.licences) == bool(want), r
    each = ["This program is free software: you can redistribute it and/or modify", "it is of no use to them", "", 'of this software and associated documentation files (the "Software"), to deal', "mit", "it was theirs"]
    docs = spark.createDataFrame([(1, "\n".join(each))], "doc_id long, text string")
    # the empty line parts two paragraphs: each, and those of their lines that have a word
    assert sorted(r.part for r in licences.candidates(docs, "doc_id", "text", licences.anchors()).collect()) == [0, 0, 1, 1, 2]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:"""


def test_wrapped_notices_and_ones_never_seen(spark):
    """Notices wrapped over lines, in comments, among prose; and wordings that no template has."""
    texts = {
        1: ("Some prose.\n\n" + MIT + "\n\nMore prose.", {"MIT"}), 2: ("x = 1\n \t\n" + BSD + "\n\ny = 2", {"BSD"}), 3: (MIT + "\n\n" + BSD, {"MIT", "BSD"}),
        4: ("Distributed under GPL v3.", {"GPL"}), 5: ("Dual MIT/Apache-2.0", {"MIT", "Apache", "unknown"}), 6: ("Released under the terms of the MPL 2.0.", {"MPL"}),
        7: ("Licence: EUPL 1.2", {"unknown"}), 8: ("This work is dedicated to the public domain", {"CC"}), 9: ("Released under the MIT licence", {"MIT"}),
        10: ("The public was free to use\nthe domain of his work, and\ndistributed copies of it.", set()),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    for r in licences.scan(docs).collect():
        want = texts[r.id][1]
        assert set(r.licences) <= want and bool(r.licences) == bool(want), r


def test_the_early_filter_changes_nothing(spark):
    """What the filter leaves out, scored all the same, is no licence."""
    words = "of it is the dog ran home a b mit und house licence version free copy 2.0 terms software under by".split()
    import random

    rng = random.Random(3)
    rows = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 5)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanner = licences.train(docs)
    key = lambda df: sorted((r.id, r.para, r.part, r.family, round(r.probability, 12)) for r in df.collect())
    every = licences.candidates(docs, "doc_id", "text", sorted({w for _, t in rows for w in t.split()}))
    assert key(scanner.scan(licences.candidates(docs, "doc_id", "text", scanner.anchors))) == key(scanner.scan(every))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (None, "MIT licensed", "y"), (3, "\n\n\n", None), (4, ("word " * 30_000) + "\n\nThe MIT License (MIT)\n\n" + "word " * 30_000, None), (4, "Apache-2.0 licensed", None), (5, " \n", "")]
    got = sorted((str(r.id), r.licences) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, licences string")).collect())
    assert got == sorted([("1", []), ("2", []), ("None", ["MIT"]), ("3", []), ("4", ["Apache", "MIT"]), ("4", ["Apache", "MIT"]), ("5", [])])


def test_dashes_dots_and_blanks_take_linear_time(spark):
    """Runs that no word ends: megabytes of them in seconds."""
    import time

    docs = spark.createDataFrame([(k, x * 1_000_000 + " licensed") for k, x in enumerate(("-", ".", "-.", " ", "a-", "a."))], "doc_id long, text string")
    began = time.time()
    assert docs.select(F.size(licences.tokens(F.col("text"))).alias("n")).where("n > 0").count() == 6
    assert time.time() - began < 60


def test_unknown_is_calibrated(spark):
    """Cuts are over a uniform guess; prose with licences' words is none, most notices never seen are found."""
    scanner = licences.Scanner(spark)
    assert all(licences.LEAST_CUT <= c < 1 for c in [*scanner.cuts.values(), scanner.licence_cut]) and scanner.temperature in licences.TEMPERATURES
    held = [(f, t) for f in licences.HELD_OUT for t in licences.HELD_OUT[f]]
    rows = [(k, t) for k, (_, t) in enumerate(held)] + [(100 + k, t) for k, t in enumerate(licences.HELD_OUT_PROSE)]
    got = {r.id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner=scanner).collect()}
    assert sum(got[k] == [f] for k, (f, _) in enumerate(held)) >= 13
    assert sum(bool(got[100 + k]) for k in range(len(licences.HELD_OUT_PROSE))) <= 1


def test_features_only_around_anchors_are_all_features(spark):
    """Grams around a template's words hold every feature that all grams hold; comparison with templates sees the same in those that are shared."""
    import random

    rng = random.Random(11)
    known = sorted({w for g in licences.vocabulary() for w in g.split()})
    texts = ["", " ", "license", "of the", "the license", "MIT", "a.b. mit. ..x"] + [" ".join(rng.choice(known if rng.random() < 0.8 else ["dog", "haus", "z"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [t for ts in licences.templates().values() for t in ts][::7]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", licences.tokens(F.col("text")))
    all_templates = [t for ts in licences.templates().values() for t in ts]
    each = df.select("words", licences.grams(F.col("words")).alias("g"), licences.anchored(F.col("words"), licences.anchors()).alias("a"))
    compared = lambda c, wrapped: licences.resemblance(all_templates, c, F.lit(wrapped))
    each = each.withColumn("met", licences.shared(all_templates, F.col("g"))).select("*", *(compared(F.col(c), w).alias(f"{c}{w}") for c in ("g", "met") for w in (True, False)))
    features = set(licences.vocabulary())
    for r in each.collect():
        assert set(r.g) & features == set(r.a) & features, r.words
        assert (r["gTrue"], r["gFalse"]) == (r["metTrue"], r["metFalse"])


def test_paragraphs_have_their_lines_words(spark):
    """A paragraph's words are those of its text as a whole: nothing goes over a line's end."""
    texts = ["one. two..\n.three MIT-\nlicence v2.0.\n2.", "Σας\nMIT ΣΑΣ\n'x' Σ.\nΣ mit", "mit\r\nx\ty\n\x0b\nmit", "mit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", licences.BLANK)).alias("para", "text")).select("id", "para", licences.tokens(F.col("text")).alias("w"))
    want = {(r.id, r.para): r.w for r in whole.collect() if "mit" in r.w}
    got = {(r.id, r.para): r.words for r in licences.candidates(docs, "doc_id", "text", ["mit"]).where("part = 0").collect()}
    assert got == want and len(want) >= 4


def test_every_held_out_notice_is_found(spark):
    """Wordings that the classifier isn't fitted on, and sentences of licence words that are none."""
    notices = [(f, x) for f, xs in licences.HELD_OUT.items() for x in xs]
    rows = [(i, x) for i, (_, x) in enumerate(notices)] + [(100 + i, x) for i, x in enumerate(licences.HELD_OUT_PROSE)]
    plain = spark.createDataFrame([(i, f"On day {i} nothing of note was seen near the river, and the boats lay still.\nLine {i * 7}.") for i in range(200)], "doc_id long, text string")
    got = {r.id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner=licences.train(plain)).collect()}
    assert sum(got[i] == [f] for i, (f, _) in enumerate(notices)) >= 16
    assert sum(bool(got[100 + i]) for i in range(len(licences.HELD_OUT_PROSE))) <= 1
