import re

from lodestar.llm import license_scan

LINES = {
    "Released under the MIT License.": "MIT-notice",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "all-rights-reserved",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_every_license_line_of_the_documents_table_is_reported(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, LINES[x]) for r in docs.collect() for x in re.findall("|".join(map(re.escape, LINES)), r.text or ""))
    got = sorted((r.doc_id, r.license) for r in license_scan.scan(docs).collect())
    assert {x[1] for x in want} == set(LINES.values()) and got == want


def found(text):
    return [m[0] for m in license_scan.best(license_scan.Index(license_scan.TEMPLATES).matches(license_scan._hashes(license_scan._memo(), text), 0.75))]


def test_each_template_is_found_as_itself():
    for name, text in license_scan.TEMPLATES.items():
        assert found(f"some words before {text} and some after") == [name]
    assert found("Released under the Apache License") == found("released under the old roof") == []


def test_places_that_follow_each_other_are_each_reported():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        n = len(text.split())
        m = license_scan.best(index.matches(license_scan._hashes(license_scan._memo(), " ".join([text] * 5)), 0.75))
        assert [(x[0], x[3], x[4]) for x in m] == [(name, k * n, k * n + n) for k in range(5)]
