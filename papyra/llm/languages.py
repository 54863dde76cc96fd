"""Problem 4: a language with a confidence for every page and for every part of a mixed one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import encoding, langmodel
from papyra.llm.langs import normal_column

#: A sample needs so many characters besides white space, and a language so large a share of them.
LEAST_CHARS = 80
LEAST_SHARE = 0.25
WHITE_SPACE = " \n\t\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

SEGMENT = "array<struct<start:int,end:int,lang:string,confidence:double>>"
RESULT = f"struct<lang:string,confidence:double,langs:array<struct<lang:string,share:double,confidence:double>>,segments:{SEGMENT}>"


def assign_languages(df: DataFrame, text: str, model: langmodel.LanguageModel, judge: encoding.Judge | None = None, out: str = "language_found") -> DataFrame:
    """df with a struct column out: main language, its confidence, shares by language, and segments.

    segments are spans of the text (of its repaired form, where judge finds it garbled), in order,
    that partition it. Null, empty or wordless text: null language, confidence null, no segments.
    Ties go to the language that comes first in langs.CODES. Whole texts are scored; no shuffle.
    """
    sc = df.sparkSession.sparkContext
    m, j = sc.broadcast(model), sc.broadcast(judge)

    @F.pandas_udf(RESULT)
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b:
                if not isinstance(t, str) or not t:
                    rows.append((None, None, [], []))
                    continue
                if j.value is not None and not t.isascii():
                    t = encoding.repair(t, j.value)[2]
                spans = m.value.spans(t)
                shares = m.value.shares(t, spans)
                rows.append((
                    shares[0][0] if shares else None,
                    shares[0][2] if shares else None,
                    [{"lang": a, "share": s, "confidence": c} for a, s, c in shares],
                    [{"start": a, "end": z, "lang": k, "confidence": c} for a, z, k, c in spans],
                ))
            yield pd.DataFrame(rows, columns=["lang", "confidence", "langs", "segments"])

    return df.withColumn(out, assign(F.col(text)))


def page_languages(pages: DataFrame) -> DataFrame:
    """Every page once, with the language its label names (label_lang) and the found one (language_found).

    The models are fitted on the pages themselves (langmodel.fit, encoding.fit_judge).
    """
    model = langmodel.fit(pages, "text_sample", "language", ["doc_id", "page_index"])
    judge = encoding.fit_judge(pages, "text_sample")
    slim = pages.select("doc_id", "page_index", "language", "text_sample")
    return assign_languages(slim, "text_sample", model, judge).withColumn("label_lang", normal_column(F.col("language")))


def find_mislabelled(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, lang: pages with a missing or wrong label, and both languages of mixed pages.

    Samples with fewer than LEAST_CHARS characters besides white space are left out. Redelivered
    rows give one row.
    """
    big = F.filter("language_found.langs", lambda x: x["share"] >= LEAST_SHARE)
    long = (F.length("text_sample") >= LEAST_CHARS) & (F.length(F.translate("text_sample", WHITE_SPACE, "")) >= LEAST_CHARS)
    found = page_languages(pages.where(long)).select("doc_id", "page_index", "label_lang", "language_found.lang", big.alias("big"))
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    langs = F.when(F.size("big") >= 2, F.transform("big", lambda x: x["lang"])).when(wrong & F.col("lang").isNotNull(), F.array("lang"))
    return found.select("doc_id", "page_index", F.explode(langs).alias("lang")).distinct()
