from lineweave.llm import license_scan
from lineweave.llm.license_values import SENTENCES


def scan(df):
    return sorted((r["doc_id"], r["license"], r["kind"], r["reading"], r["first_sentence"]) for r in license_scan.license_matches(df).collect())


def test_rules_in_order_with_gaps_and_wrapped_texts(docs):
    mit = "\n".join([SENTENCES[12] + ":", "", SENTENCES[13] + ".", "Copyright (c) A. Author", SENTENCES[14] + ".", SENTENCES[15] + "."])
    wrapped = SENTENCES[31].replace(" ", "\n", 20) + "."
    found = scan(docs((1, "junk***\nReleased under the MIT License.\nmore"), (2, mit), (3, wrapped), (4, None), (5, ""), (6, "the license"),
                      (7, "Licensed under CC BY-NC 4.0. All rights reserved."), (7, "Licensed under CC BY-NC 4.0")))
    assert (1, "MIT", "notice", "line", 1) in found and (2, "MIT", "text", "line", 0) in found
    assert (3, "GPL-3.0-or-later", "notice", "wrapped", 1) in found
    assert [f[1] for f in found if f[0] == 7].count("CC-BY-NC-4.0") == 2
    assert not any(f[0] in (4, 5, 6) for f in found)


def test_every_known_sentence_is_found(docs):
    rows = [(n, text + ".") for n, text in SENTENCES.items()]
    single = {ids[0] for _, _, ids in license_scan.RULES if len(ids) == 1}
    assert {f[0] for f in scan(docs(*rows))} == single
    assert len(license_scan.KNOWN) == len(SENTENCES)


BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
       "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
       "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
       "documentation and/or other materials provided with the distribution.\n")
GPL2 = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n")


def test_texts_of_licences(docs):
    """Texts as files have them, against the licence that a reader would name."""
    third = "* Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    ad = "* All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes x.\n"
    isc = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
           "copyright notice and this permission notice appear in all copies.\n")
    cases = {
        1: (BSD + third.format("Google Inc."), "BSD-3-Clause"), 2: (BSD + third.format("the copyright holder"), "BSD-3-Clause"), 3: (BSD, "BSD-2-Clause"),
        4: (BSD + ad + third.format("The Regents, a body"), "BSD-4-Clause"), 5: (GPL2, "GPL-2.0-or-later"), 6: (isc, "ISC"),
        7: ("/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0-only"), 8: ("# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"),
        9: ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
        10: ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "GPL-3.0"), 11: (GPL2.replace("General", "Lesser General").replace("2 of", "2.1 of"), "LGPL-2.1-or-later"),
        12: ("This is free and unencumbered software released into the public domain.\n", "Unlicense")}
    found = scan(docs(*[(i, text) for i, (text, _) in cases.items()]))
    for i, (_, name) in cases.items():
        assert {f[1] for f in found if f[0] == i} == {name}, (i, name, [f for f in found if f[0] == i])


def test_a_rule_on_a_line_and_wrapped_elsewhere_gives_both(docs):
    text = "Licensed under the MIT License.\n\nother words\n\nLicensed under\nthe MIT License.\n"
    assert [f[1:4] for f in scan(docs((1, text)))] == [("MIT", "notice", "line"), ("MIT", "notice", "wrapped")]
    assert [f[1:4] for f in scan(docs((1, text), (1, text)))].count(("MIT", "notice", "wrapped")) == 2
    apart = SENTENCES[20] + ":\n" + "\n".join(f"Between {n}." for n in range(5)) + f"\n{SENTENCES[21]}.\n{SENTENCES[22]}.\n"
    assert [f[1] for f in scan(docs((1, apart + "long tail " * 20_000)))] == ["BSD-2-Clause"]


def test_empty_table(docs):
    assert license_scan.license_matches(docs((1, "a")).limit(0)).count() == 0
