from landrank.llm import license_scan as ls

GPL = ls.TEMPLATES["gpl-notice"]
CASES = [
    ("released under the new rules", ""),
    ("released under the apache license", "apache"),
    ("Licensed under the Apache License.", "apache"),
    ("licensed under the apache license, version 1.1", "apache"),
    ("this work is licensed under the GNU General Public License, version 2", "gpl"),
    ("this work is licensed under the GNU Lesser General Public License version 3", ""),
    (GPL.replace("gnu general", "gnu lesser general"), ""),
    ("licensed under CC BY-NC 3.0", "cc-by"),
    ("licensed under CC BY-NC-SA 4.0", "cc-by"),
    ("this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ""),
    ("this work is licensed under a creative commons attribution 3 0 international license", ""),
    ("released under the MIT License", "mit,mit-release"),
    ("released under the terms of the MIT License", "mit,mit-release"),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
    ("licensed under the apache license 2.0", "apache,apache-2.0"),
    ("this program is licensed under the gnu general public license version 3", "gpl,gpl-3.0"),
    (GPL.replace("redistribute it and or modify", "redistribute and modify"), "gpl,gpl-notice"),
    ("licensed under cc by nc 4 0", "cc-by,cc-by-nc-4.0"),
    (ls.TEMPLATES["cc-by-4.0"], "cc-by-4.0"),
    (ls.TEMPLATES["mit-notice"].replace("free of charge ", ""), "mit-notice"),
    ("licensed under the apache license version 1 1 " + "filler " * 9 + "see apache license version 2", "apache"),
    ("released under the new rules " * 50 + ls.TEMPLATES["mit-release"], "mit,mit-release"),
]


def test_names_and_versions_tell_licences_apart(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in ls.scan_licenses(docs).collect()}
    assert [(text, got[i][0]) for i, (text, _) in enumerate(CASES)] == CASES
    assert got[0][1] == 0.0 and got[2][1] == 0.5 and got[11][1] == 1.0


def test_a_text_of_many_notices_takes_time_in_proportion(spark):
    import time

    def took(n: int) -> float:
        docs = spark.createDataFrame([(1, "released under the mit license\n" * n), (2, "released under the new rules\n" * n)], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: (r.labels, r.score, r.n_base) for r in ls.scan_licenses(docs).collect()}
        assert got == {1: ("mit,mit-release", 1.0, n), 2: ("", 0.0, 0)}
        return time.time() - began

    took(10)
    few, many = took(10_000), took(100_000)
    assert many < 20 * max(few, 1.0)
