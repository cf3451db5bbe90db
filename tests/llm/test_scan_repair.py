from marlstone.llm import scan_repair as sr

SCHEMA = "parsed_id bigint, filename string, raw_text string, n bigint, scanned boolean"
CLEAN = ("[PAGE 1]\nThe certificate issued at the harbour covers only rolled water meters of mixed origin in the district. "
         "The certificate of the officer applies to the goods described and to the rate of 5 percent under section 12B of the rules.")
SCAN = """[PAGE 1]
Notice on rolled water meters
Public Notice on rolled water meters

The certificate issued at the harbour covers only rolled water rneters of mixed origin in the dis-
trict of the officer. The certificatc applies to the goods described and to the rate of 5 percent
under section 12B of the ~ rules. The goods described of mixed origin and the rate of 5 percent un-
Page 1 of 2

[PAGE 2]
Notice on rolled water meters
der the rules. The officer applies the rate of Z0 percent to the goods described and to the mixed
goods of the certificate.
Page 2 of 2"""


def rows(*scans):
    return [(i, "a.docx", CLEAN, 0, True) for i in range(5)] + [(100 + k, "s.PDF", t, 0, True) for k, t in enumerate(scans)]


def test_damages(spark):
    fitted = sr.ScanRepair(spark.createDataFrame(rows(SCAN), SCHEMA))
    got = {tuple(r) for r in fitted.damages().collect()}
    assert got == {(100, 2, "furniture"), (100, 8, "furniture"), (100, 11, "furniture"), (100, 14, "furniture"), (100, 5, "broken_word"), (100, 7, "broken_word"),
                   (100, 5, "misread"), (100, 6, "misread"), (100, 7, "misread"), (100, 12, "misread")}
    text = {r[0]: r[2] for r in fitted.repaired().collect()}
    assert "rolled water meters of mixed origin in the district of the officer. The certificate applies" in text[100]
    assert "under section 12B of the rules." in text[100] and "percent under the rules. The officer applies the rate of 20 percent" in text[100]
    assert "Page 2" not in text[100] and text[0] == CLEAN


def test_no_clean_texts_and_odd_rows(spark):
    odd = [(1, None, None, 0, None), (None, "a.pdf", "x", 0, None), (2, "b.pdf", "", 0, None), (3, None, "word " * 20_000, 0, None), (4, "c.pdf", "x" * 100_000 + "\n" + "†" * 999, 0, None),
           (5, "s.pdf", SCAN, 0, None), (5, "s.pdf", SCAN, 0, None)]
    fitted = sr.ScanRepair(spark.createDataFrame(odd, SCHEMA))
    got = {tuple(r) for r in fitted.damages().collect()}
    assert {(5, 2, "furniture"), (5, 5, "broken_word")} <= got and {r[0] for r in got} == {5}
    assert {r[0] for r in fitted.repaired().collect()} == {2, 3, 4, 5}
    empty = sr.ScanRepair(spark.createDataFrame([], SCHEMA))
    assert empty.damages().count() == 0 and empty.repaired().count() == 0


def test_page_numbers_in_any_form():
    for line in ("Page 3", "- 12 -", "[7]", "iv", "Page 2 of 9", "— 3 —", "12", "3 / 8"):
        assert sr.NUMBER.fullmatch(line) or sr.NUMBER_ONLY.fullmatch(line), line
    for line in ("Section 3", "Kinmere Works.", "in 2019 and", "under file 893."):
        assert not sr.NUMBER.fullmatch(line) and not sr.NUMBER_ONLY.fullmatch(line), line


def _lines(text):
    return [x.strip() for x in text.strip().split("\n")]


def test_short_scans_among_site_lines():
    # sf0.01: parsed_id 344, wraps ahead of capitals
    capitals = """[PAGE 1]
Notice on glazed musical strings of assorted sizes for Marfeltaroth Felsilmere

Explanation. Having heard Drabalak Brothers on 22 May 2021, entry of spun tyre cords for
re-export through Polborrila Quay is limited to 133 tonnes as recorded at Zangarsalstead
Basin. Under the Farrenoldale scheme notified on 8 May 2016, the freight of Galhelsalona
Traders forms part of the value of vulcanised fan blades in the order made at Yelolzelford.

Section 131A of the Customs Act and frozen palm kernels from Kalrildunia

6. As the records of Zelbordunona Stores show, the test report on vulcanised fishing nets
of mixed origin from Vengalmere holds for 660 months as argued for Ordalyelis Foundry.
[1]"""
    # check_l 22085: a single wrap, ahead of a capital, among site lines
    site = """[PAGE 1]
Subscribe to the weekly letter of Gorilrildale Customs Digest and never miss a change of rate
Instruction on pressed cotton yarn for Felmongaroth Yarmornoreth

CHAPTER 1 DUNGRIOS TELYARGORHOLM

Provided that in supersession of the Caldoros notice of 24 June 2013, the broker of Urzanbraum
Brothers chose 7013 in error as in the case of Ultorpolum and Finlordalor.
Page 1
Next: latest notices from Norvenune | Previous: archive 2016
Terms of use | Privacy | Contact Gorilrildale"""
    furniture = "\n".join(["Heading of the page", "Published by the desk of the site"] * 9)
    hyphen = f"{furniture}\nThe certificate issued at the harbour covers only rolled water meters in the dis-\ntrict of the officer.\n{furniture}"
    misread = f"{furniture}\nThe certificate issued at the harbour covers only rolled water meters of Gor\nStores in the pre5ence of the officer.\n{furniture}"
    numbered = "[PAGE 1]\nOrder on roof sheets\n\nCHAPTER VI CALCORMERE KINKORFORD\n- 13 -\nTerms of use | Privacy | Contact"
    for text in (capitals, site, hyphen, misread, numbered):
        assert sr.is_scanned("a.pdf", "\n".join(_lines(text)))
        assert not sr.is_scanned("a.docx", text)


def test_site_lines_are_no_wraps():
    # sf0.1: parsed_id 1723, where site lines and headings follow one another
    text = """[PAGE 1]
Terms of use | Privacy | Contact Lorsilin
PRINTED ON 05.05.2015 FROM THE READING ROOM OF HELNELNARFORD
Home > Notices > Helnelnarford > Read in full
SUBSCRIBE TO THE WEEKLY LETTER OF LORSILIN CUSTOMS DIGEST AND NEVER MISS A CHANGE OF RATE
Ruling on tempered tea leaves of one brand for Taldunan Monnordorholm
Ref: NELD/956/2020
Section 172A of the Customs Act and flanged bed linen for tender supply from Ordundunum
5. Because smoked plywood panels were re-packed, the Registry of Origin Marks directs that smoked candle wax on consignment be kept.
The broker of Telmargorash Brothers chose 5649.54 in error as agreed with Yelrilcalin and Heltulbraia. By its letter it was kept.
Section 30 of the Customs Act and frozen welding rods without fittings from Torlenan
Reported by Silgareth Valilfarune for the Lorsilin desk"""
    assert not sr.is_scanned("a.pdf", text)


def test_counts_are_held_in_bounded_numbers():
    import pandas as pd

    rows = pd.DataFrame({"filename": ["a.docx"] * 400, "raw_text": [" ".join(f"w{i % 300}x{k}" for k in range(50)) for i in range(400)]})
    frames = list(sr._counts(iter([rows]), 1000))
    assert max(map(len, frames)) <= 1000 + 101
    whole = next(sr._counts(iter([rows]), 1 << 30))
    key = ["scanned", "a", "b"]
    assert pd.concat(frames).groupby(key)["n"].sum().to_dict() == whole.groupby(key)["n"].sum().to_dict()


def test_candidates_are_held_in_bounded_number(monkeypatch):
    monkeypatch.setattr(sr, "CANDIDATES", 10)
    lexicon = sr.Lexicon({"modern": 5, "rate": 5}, {})
    for k in range(100):
        lexicon.candidates("x" * (k % 30) + "rnodern")
    assert len(lexicon.known) <= 10 and lexicon.candidates("rnodern")[0][0] == "modern"
