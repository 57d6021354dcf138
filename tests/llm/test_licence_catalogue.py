"""Licences beyond the notices of the test tables, from their texts as they are usually written."""
import duckdb
import pandas as pd

from shelfwise.llm import licences

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADVERTISING = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
     This product includes software developed by the organization.
"""
ENDORSE = """
4. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GRANT = """This {0} is free software; you can redistribute it and/or modify it under the terms of the
GNU {1} as published by the Free Software Foundation{2}.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even more."""
TEXTS = [
    (BSD, "BSD-2-Clause"), (BSD + ENDORSE.format("the copyright holder"), "BSD-3-Clause"), (BSD + ENDORSE.format("Example Labs"), "BSD-3-Clause"),
    (BSD + ENDORSE.format("Example Inc."), "BSD-3-Clause"), (BSD + ADVERTISING + ENDORSE.format("the University"), "BSD-4-Clause"),
    (GRANT.format("library", "Lesser General Public License", "; either\nversion 2.1 of the License, or (at your option) any later version"), "LGPL-2.1-or-later"),
    (GRANT.format("library", "Lesser General Public License", ", either\nversion 2.1 of the License, or (at your option) any later version"), "LGPL-2.1-or-later"),
    (GRANT.format("program", "Affero General Public License", ", either\nversion 3 of the License, or (at your option) any later version"), "AGPL-3.0-or-later"),
    (GRANT.format("program", "General Public License version 2", ""), "GPL-2.0-only"),
    (GRANT.format("program", "General Public License", "; either version 2\nof the License, or (at your option) any later version"), "GPL-2.0-or-later"),
    (GRANT.format("program", "General Public License", "; version 2 of the License"), "GPL-2.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL is gone", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
     "copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\n"
     "freely, subject to the following restrictions:\n\n1. More", "Zlib"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
     "distribution.", "EPL-1.0"),
    ("This data set is released under the MIT license.", "MIT"), ("The code is made available under the terms of the Apache License 2.0.", "Apache-2.0"),
    ("Our corpus is distributed under the CC BY-SA 4.0 licence.", "CC-BY-SA-4.0"), ("Licensed under the 3-clause BSD license.", "BSD-3-Clause"),
    ("This software is not licensed under the MIT license.", ""), ("It went under the MIT license.", ""), ("All rights reserved.", ""),
]


def test_texts_and_mentions(docs_of):
    got = {r["doc_id"]: ",".join(r["licences"]) for r in licences.licences(docs_of(enumerate(t for t, _ in TEXTS))).collect()}
    assert [(i, got[i]) for i, _ in enumerate(TEXTS)] == [(i, want) for i, (_, want) in enumerate(TEXTS)]


def test_sql_reads_the_same_texts():
    documents = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": [t for t, _ in TEXTS]})
    with duckdb.connect() as connection:
        connection.register("documents", documents)
        got = {i: found for i, _, found in connection.execute(licences.SQL).fetchall()}
    assert [got[i] for i in range(len(TEXTS))] == [want for _, want in TEXTS]
