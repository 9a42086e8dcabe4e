"""IBANs before a BIC, a capitalised word or another IBAN."""

from cellwright.llm import pii


def test_iban_before_capitals(spark):
    said = {
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": ["DE89 3704 0044 0532 0130 00"],
        "IBAN DE89370400440532013000 Please pay": ["DE89370400440532013000"],
        "DE89370400440532013000 BIC COBADEFF": ["DE89370400440532013000"],
        "DE89370400440532013000": ["DE89370400440532013000"],
        "GB82 WEST 1234 5698 7654 32 FR14 2004 1010 0505 0001 3M02 606 AND NO93 8601 1117 947.": ["GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947"],
        "REF AB12 CDEF GHIJ DE89 3704 0044 0532 0130 00 X": ["DE89 3704 0044 0532 0130 00"],
        "é😀 DZ580002100001113000000570 PLEASE": ["DZ580002100001113000000570"],
        "DE89370400440532013000X": [],
        "DE89370400440532013000please": [],
        "DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX": [],
    }
    texts = list(said)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        t = texts[r.doc_id]
        assert [t[s.start : s.end] for s in r.spans if s.kind == "iban"] == said[t], t
    clean = {texts[r.doc_id]: r.text for r in pii.redact(df).collect()}
    assert clean[texts[0]] == "IBAN [IBAN] BIC COBADEFFXXX" and clean[texts[1]] == "IBAN [IBAN] Please pay"
