from quartzfold.llm import stuffing

SPEECH = "I rise to support the proposal on bridge repairs, which remains urgent in the view of the committee. Does the minister accept that road tolls and school meals cannot both be paid from one fund? We have heard the member say that it was fair, and I regret it. "
PAGES = {
    1: SPEECH * 2,
    2: "cheap roof tiles buy watches cheap roof tiles top perfume buy watches cheap roof tiles buy watches cheap roof tiles",
    3: "\n".join(f'<a href="https://h{i}.example/x">phone cases</a>' for i in range(12)),
    4: "#cheap #watches #sale #discount #loans #tyres #detox #best",
    5: "\n".join(f"www.site{i}.test/a/b?id={i}" for i in range(20)),
    6: "Division 12. Ayes: " + "; ".join(f"{a} {b}" for a in ("Anna", "Bo", "Cy") for b in ("Kay", "Lom", "Mun")) + ".",
    7: "\n".join(f"{i}. the harbour levy (Old Mill Party, {i}/26)" for i in range(1, 20)),
    8: "\n".join(f"harbour levy: {i} | 4 | 95 | 411" for i in range(20)),
    9: "(Applause)",
    10: SPEECH * 2 + "See www.report.test/a and https://paper.test/b for it.",
    11: SPEECH + " ".join(["g-ü-n-s-t-i-g- -e---b-o-o-k-s", "Günstig E-Books", "günstig 3-books"] * 40),
    12: "",
    13: None,
    14: "\n".join(f"[best loans](http://x{i}.test/y)\ntop tyres – www.z{i}.test/q" for i in range(8)),
    15: "x " * 200_000,
}


def test_pages(spark):
    df = spark.createDataFrame([(i, t, None if i % 3 else "h") for i, t in PAGES.items()], "id bigint, text string, host string").selectExpr("*", "1 as words", "2 as phrase")
    got = {r["id"] for r in stuffing.spam_pages(df).collect()}
    assert got == {2, 3, 4, 5, 11, 14, 15}
    assert stuffing.evidence(df).count() == len(PAGES)
    assert stuffing.evidence(df.where("false")).count() == 0


def test_replication_decides_pieces_in_doubt(spark):
    piece = "harbour levy school meals the grain reserve urgent road tolls in valleys school meals rural routes bridge"
    own = "lake charter dairy premium the tram reserve careful bridge funds in hills dairy premium night routes ferry"
    rows = [(1, piece, "a"), (2, piece, "b"), (3, piece, "c"), (4, own, "a"), (5, own, "a")]
    got = {r["id"]: r["stitched"] for r in stuffing.evidence(spark.createDataFrame(rows, "id bigint, text string, host string")).collect()}
    assert got[1] > 0 and got[2] > 0 and got[4] == got[5] == 0


def share(text):
    total, listed, _ = stuffing.measure(text)
    return listed / total


def test_product_items_and_lists_between_bars():
    items = [f"SKU DOUBOX-{1400 + i} {g} olive {i}.99" for i, g in enumerate(("casino bonus", "e-books", "roof tiles", "tyres") * 3)]
    assert all(share(between.join(items)) > 0.9 for between in ("\n", " | ", "; "))
    assert share("free replica | best roof tiles | barato slimming tea | best roof tiles | free replica | barato slimming tea | best roof tiles") == 1
    assert share("Budget of the ministry | spent | left | total\n" + "\n".join(f"harbour levy | {i} | 95 | 411" for i in range(9))) == 0
    assert share("\n".join(f"{i}) 3/{i} ; 9.{i}" for i in range(9))) == 0


def test_short_lines_and_sentences_are_joined():
    goods = ["best tyres", "tyres Glaepeim", "online garden lamps", "slimming tea Soudixford", "buy phone cases", "water filters Trykom-sur-Vey"] * 4
    assert share("\n".join(goods)) == 1
    assert share("\n".join(f"{i}. {g}" for i, g in enumerate(goods))) == 1
    assert share(" ".join(["Buy loans.", "Loans online.", "Loans?  Loans!", "Cheap loans here.", "Best loans."] * 5)) == 1
    assert share("best loans\nwww.site.test/a\ncheap tyres\nwww.tyres.test/b\n") == 1
    assert share("(Applause)\nWer stimmt dafür? Die Gegenprobe! Enthaltungen?\n(Heiterkeit)\n– Hear, hear!\n– Hear, hear!\n– Hear, hear!") == 0
    assert share("\n".join(f"{a} {b}" for a in ("Anna", "Bo", "Cy") for b in ("Kay", "Lom", "Mun"))) == 0


def test_phrases_are_counted_in_all_pieces(spark):
    doubtful = "harbour levy school meals the grain reserve urgent road tolls in valleys school meals rural routes bridge"
    # The same phrases in a list decided by density and in running text.
    decided = "harbour levy school meals the grain reserve urgent road tolls " * 5
    running = "We have heard that the harbour levy school meals the grain reserve urgent road tolls in valleys school meals rural routes bridge were all that they had and it is not for us to say who should have been there."
    assert len(stuffing.measure(doubtful)[2]) == 1 and not stuffing.measure(decided)[2] and not stuffing.measure(running)[2]
    own = "lake charter dairy premium the tram reserve careful bridge funds in hills dairy premium night routes ferry"
    rows = [(1, doubtful, "a"), (2, decided, "b"), (3, running, "b"), (4, own, "a"), (5, decided, "a")]
    got = {r["id"]: r["stitched"] for r in stuffing.evidence(spark.createDataFrame(rows, "id bigint, text string, host string")).collect()}
    assert got[1] > 0 and got[4] == 0


def test_strong_recurrence_decides_whatever_the_function_words():
    assert share("hoteles en la costa " * 100) == 1
    assert share("official d3tox offici@l detox o-f-f-i-c-i-a-l- -d-e-t-o-x OFFICIAL DETOX " * 6) == 1
    assert share(SPEECH * 20) == 0


def test_phrases_run_across_lines_and_digits_count_as_zero(spark):
    rows = [(1, "red roof\ntiles 17 cheap\nwatches", "a"), (2, "x y red roof tiles 23 cheap watches zz", "b"), (3, "red roof tiles 55 cheap watches", "c"), (4, "the red roof tiles 55 and cheap watches", "d"), (5, "lone words on this host only and nowhere", "e"), (6, "1 2 3 4 5 6 7", "f"), (7, "8 9 1 2 3 4 5", "g")]
    got = {r["id"]: r["replicated"] for r in stuffing.evidence(spark.createDataFrame(rows, "id bigint, text string, host string")).collect()}
    assert got == {1: 6, 2: 6, 3: 6, 4: 0, 5: 0, 6: 0, 7: 0}


def test_words_of_compounds_are_no_function_words():
    goods = ["top amber", "loans Drouzour-sur-Vey", "yoga mats Ploufeith-sur-Vey", "outlet tyres Kyn-sur-Vey", "ladders Baegol-sur-Vey", "casino bonus Veimyn-sur-Vey", "barato cases", "curtains Rath-sur-Vey", "sneakers"]
    assert share("\n".join(goods)) == 1 and share(" ".join(goods)) == 1
