"""Texts for the tests of the corpus operators."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def document_texts() -> list[str]:
    return [t or "" for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").to_pylist()]


def odd_texts() -> list[str]:
    return [
        "",
        " ",
        "\n\n\n",
        "a",
        "  lead and trail  ",
        "don't can't we'll I'm they've he'd",
        "tabs\tand\rreturns\x0band\x0cfeeds",
        "file\x1cgroup\x1drecord\x1eunit\x1fseparators",
        "next\x85line no\xa0break thin space line separator wide　space",
        "İstanbul ıslak ſtraße STRASSE ẞ ß K Å ΣΑΣ ς",
        "é combining ́ alone, ﬁ ligature ½ ² ① Ⅷ",
        "漢字とかな 한국어 ไทย हिन्दी العربية עברית",
        "🙂👩‍👩‍👧 flags 🇩🇪 zero​width‍join﻿",
        "<|endoftext|> in <|startoftext|>text<|endoftext|>x",
        "x.y,z;a:b!c?d x. y, z; a: b! c? d ... ,,, ?!",
        "1234567890 3.14159 1,000,000 0xFF v2.0.1",
        "a" * 3000,
        "ab " * 3000,
        "no_white_space_" * 500,
        "!" * 2000 + " " + "é" * 2000,
        "\0 nul \0\0 x\0y",
        "MixedCase ALLCAPS camelCase snake_case kebab-case",
        "end with space \n",
        "line one\nline two\r\nline three\n\nline five",
        "word  two   three    spaces\n  indented\n\tTabbed",
    ]
