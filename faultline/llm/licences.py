"""Licence scans by canonical digest lookup.

A text is normalised (case, copyright lines, punctuation, equivalent spellings,
white space), and the SHA-256 of the normal form of the whole text, and of each of
its lines, is hash-joined to the digests of known licence texts and notices.  The
list of known digests is fixed and short, so its broadcast is bounded.

Lines are joined before a whole text is digested, so wrapping makes no difference;
of lines, only those that state a copyright by sign or year, or that all rights are
reserved, are left out, wherever a licence's own sentences break.

DataFrame functions only.  Defined cases: null and empty texts match nothing, and an
empty table gives an empty result; very long texts are digested whole; rows repeated
in the table give repeated results; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ascii_lower, written

# SPDX identifiers with licence texts and notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
# The two BSD licence texts.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
NOTICES += [("BSD-2-Clause", BSD.format("")), ("BSD-3-Clause", BSD.format(NO_ENDORSEMENT))]
# Digests of the normal forms of whole texts as published (of Apache-2.0 also without its appendix).
DIGESTS = [
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "67838d8b93dec631367ba027330812a986f27a95c3e70b9f5607dd940303530c"),
    ("GPL-3.0", "bee9dba9f021a216f672b1621f7b1bb7fd0a516f6732197fad5e9fd1013fdbc6"),
    ("LGPL-2.1", "0e8046ce7f9eec5420003481be92280a0b9d44a1ff6aff0dcabf8c78f88a35b9"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "4e3ed3db421caff5beab12d8b5ed5c6f8edb888f5430801b1624448d4d7f04fe"),
]
TITLES = {"BSD-2-Clause": ["", "BSD 2-Clause License\n"], "BSD-3-Clause": ["", "BSD 3-Clause License\n"], "MIT": ["", "MIT License\n", "The MIT License\n", "The MIT License (MIT)\n"], "ISC": ["", "ISC License\n"]}

COPYRIGHT = (r"(?m)^[^0-9a-z\n]*((copyright[^0-9a-z\n]+(c[^0-9a-z]|[0-9]{4})|copyright[^0-9a-z\n]*©|\(c\)[^0-9a-z\n]*[0-9]{4}|©)[^\n]*"
             r"|all rights reserved[^0-9a-z\n]*)$")
OUTSIDE = r"[^0-9a-z\n\x{80}-\x{10FFFF}]+|[\x{80}-\x{BF}\x{2000}-\x{206F}]+"
EDGES = r"(?m)^ +| +$"
SPELLINGS = [("licenc", "licens"), ("organis", "organiz"), ("sub-licens", "sublicens"), ("non-infring", "noninfring"),
             ("holder", "owner"), ("&", " and "), ("as-is", "as is")]


def normal_lines(text: Column) -> Column:
    """Non-empty normalised lines."""
    t = F.regexp_replace(ascii_lower(text), COPYRIGHT, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, OUTSIDE, " "), EDGES, "")
    return F.array_remove(F.split(F.coalesce(t, F.lit("")), "\n"), "")


def digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known(spark) -> DataFrame:
    """licence, digest of every known text."""
    rows = [(name, title + body) for name, body in NOTICES for title in (TITLES.get(name, [""]) if "\n" in body else [""])]
    t = spark.createDataFrame(rows, "licence string, text string").select("licence", digest(normal_lines(F.col("text"))).alias("digest"))
    return t.union(spark.createDataFrame(DIGESTS, "licence string, digest string")).distinct()


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (sorted identifiers, comma-joined) found as a whole line
    or the whole text, n_licences, and whole_text (the text is nothing else)."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.xxhash64("text").alias("t"), normal_lines(F.col("text")).alias("lines"))
    whole = digest(F.col("lines"))
    units = d.select("doc_id", "t", whole.alias("whole"),
                     F.explode(F.array_union(F.array(whole), F.transform("lines", lambda x: F.sha2(x, 256)))).alias("digest"))
    found = units.join(F.broadcast(known(spark)), "digest").groupBy("doc_id", "t").agg(
        F.array_sort(F.collect_set("licence")).alias("found"), F.max(F.col("digest") == F.col("whole")).alias("whole_text"))
    found = written(found, "licences").alias("f")
    k = docs.select("doc_id", F.xxhash64("text").alias("t")).alias("k")
    return (k.join(found, F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("k.t") == F.col("f.t")), "left")
            .select("k.doc_id", F.coalesce(F.array_join("f.found", ","), F.lit("")).alias("licences"),
                    F.coalesce(F.size("f.found"), F.lit(0)).alias("n_licences"),
                    F.coalesce("f.whole_text", F.lit(False)).alias("whole_text")))
