"""Odd rows that every operator must survive."""

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n \t",
    "a",
    "a a a a a a a a a a a a a a",
    "ΑΣ ΣΑΣ É é ñandú ﬁ İstanbul",
    "it's WE'VE don't 1234 x²  two  blanks ",
    "tail<|endoftext|>head <|startoftext|> <|endoftext",
    "odd\x1cbreak\x85next nbsp　wide​zero",
    "漢字かな交じり文 \U0001f600\U0001f600 emoji",
    "w" * 5000,
    "word " * 3000,
    "same row",
    "same row",
]


def odd_docs(spark):
    """documents with odd texts, a column in other case and a column named as an output."""
    rows = [(i, t, i, "clash") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_tokens int, kept string")


def plain(text):
    return "" if text is None else text
