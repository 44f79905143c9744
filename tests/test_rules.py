"""Text rules on small inputs, with results written down by hand: nothing here is taken from the word lists."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.operators import graph as gr
from tideline.operators import research as rs
from tideline.sources import documents as sd


def on(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


CASES = {
    "society": (lambda c: tx.society(c, default="Unknown"), {
        "ABS Rules, see DNV": "DNV", "Lloyd's Register": "LR", "Lloyds  Register": "LR", "LRX": "Unknown", "dnv": "Unknown", "Bureau Veritas NR": "BV", "Nippon Kaiji Kyokai": "NK",
        "Korean Register and IMO": "KR", "Registro Italiano Navale": "RINA", "IACS UR": "IACS", "": "Unknown",
    }),
    "year": (tx.version_year, {"edition 2019": "2019", "120245": "2024", "in 1899": None, "1998 and 2003": "1998", "": None}),
    "chapter": (tx.chapter_section, {
        "see Pt.4 Ch.3 of": "Pt.4 Ch.3", "Pt 4": "Pt 4", "Part 3 Section 5-2": "Part 3 Section 5-2", "第 4 章": "第 4 章", "Chapter 12": "Chapter 12", "§ 5.2": "§ 5.2", "none": None,
    }),
    "steel": (gr.steel_grades, {"EH36 and AH32, EH36": ["EH36", "AH32"], "E36 EH3 XEH3600": [], "DNV100": ["DNV100"]}),
    "equipment": (gr.equipment, {"Type-A1 and model: B22": ["Type-A1", "model: B22"], "Type A": []}),
    "parameters": (gr.parameters, {"25 mm at 100 C, 2.5 MPa, 400 °C": ["100 C", "400 °C", "25 mm", "2.5 MPa"], "5 C": [], "mm": []}),
    "ships": (gr.ship_types, {"A Bulk Carrier": ["bulk carrier"], "": []}),
    "clauses": (lambda c: F.transform(gr.clause_spans(c), lambda x: x["m"]), {"Pt.4 Ch.3 and § 5.2": ["Pt.4 Ch.3", "§ 5.2"], "Section 4.2, Part 7": ["Section 4.2", "Part 7"], "no": []}),
    "negated": (lambda c: F.transform(gr.not_negated(c, gr.spans(c, [r"\b[A-Z]{2}\d\d\b"])), lambda x: x["m"]), {
        "EH36, except DH32. AH40": ["EH36", "AH40"], "excluding EH36 and AH40": [], "not applicable to EH36. EH36": ["EH36"], "does not apply to AH32": [], "except.": [],
    }),
    "parameter names": (rs.normalised, {"板厚": "thickness", " 温度 ": "temperature", "Speed": "speed", "强度": "strength"}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    f, cases = CASES[name]
    assert dict(zip(cases, on(spark, f, [*cases]), strict=True)) == cases


def test_formats(spark):
    rows = [("a.bin", b"%PDF-1.7", "pdf"), ("a.csv", b"\x89PNG\r\n", "image"), ("b.DOCX", b"PK\x03\x04zz", "docx"), ("c.zip", b"PK\x03\x04", None), ("d.html", b"", "html"), ("e", b"<html><body>", "html"), ("f", b"<!DOCTYPE html>", "html"), ("g.tif", b"II*\x00..", "image"), ("h.xyz", b"abc", None)]
    found = spark.createDataFrame([(p, bytearray(c)) for p, c, _ in rows], "path string, content binary").select("path", sd.detect_format(F.col("path"), F.col("content")).alias("f")).collect()
    assert {r["path"]: r["f"] for r in found} == {p: f for p, _, f in rows}
