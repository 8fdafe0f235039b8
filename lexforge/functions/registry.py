"""The engine's functions by name for Spark SQL: scalars, and table functions for records and tagged words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators.align import CLUSTERS, levenshtein, value_ratio, words_of_tagged


class ParseMdf:
    """Rows of a record text: record_index, line_in_record, line_index, marker, value."""

    def eval(self, mdf: str) -> Iterator[tuple]:
        record, inside, index, open_ = -1, 0, 0, False
        for line in (mdf or "").splitlines():
            line = line.strip()
            m = re.match(r"\\([A-Za-z0-9_-]+)\s+(.*)$", line)
            if not line:
                open_ = False
            elif m:
                if not open_:
                    record, inside, open_ = record + 1, 0, True
                yield record, inside, index, m[1], m[2].strip()
                inside, index = inside + 1, index + 1


class TaggedWords:
    """Rows of a marked-up line: word_no, word, tags open at it."""

    def eval(self, line: str) -> Iterator[tuple]:
        for k, w in enumerate(words_of_tagged(line)):
            yield k, w["word"], w["tags"]


def register(spark: SparkSession) -> None:
    """Registers nfc, casefold_letters, strip_marks, grapheme_len, grapheme_distance, token_distance and value_similarity, and the table functions parse_mdf and tagged_words."""
    spark.udf.register("nfc", text.nfc)
    spark.udf.register("casefold_letters", text.casefold_letters)
    spark.udf.register("strip_marks", text.strip_marks)

    @F.pandas_udf("double")
    def value_similarity(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([value_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("int")
    def grapheme_distance(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if x is None or y is None else levenshtein(CLUSTERS[x], CLUSTERS[y]) for x, y in zip(a, b)], dtype="Int32")

    @F.pandas_udf("int")
    def token_distance(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if x is None or y is None else levenshtein(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")

    spark.udf.register("value_similarity", value_similarity)
    spark.udf.register("grapheme_distance", grapheme_distance)
    spark.udf.register("token_distance", token_distance)
    spark.udtf.register("tagged_words", F.udtf(TaggedWords, returnType="word_no: int, word: string, tags: array<string>"))
    spark.sql("create or replace temporary function grapheme_len(s string) returns int return size(regexp_extract_all(s, '(\\\\X)', 1))")
    spark.udtf.register("parse_mdf", F.udtf(ParseMdf, returnType="record_index: int, line_in_record: int, line_index: int, marker: string, value: string"))
