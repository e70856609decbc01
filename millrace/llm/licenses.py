"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

The lines, the paragraphs and the whole of a text are units, and so are windows over
its words, so that a notice is found wherever lines break and whatever stands around it. A template can only
match a unit whose number of bigrams lies within bounds that follow from the
threshold, and only if the unit holds one of a few anchor words (also derived:
a match shares so many bigrams that some must hold one). Windows are all runs of words that a template could match: each grows bigram by
bigram with running counts, so the best one is found. They are laid only where a text as a whole shares enough bigrams
with a template. Everything stays in the document's row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
DICE = 0.8

# Public licence notices, and the bodies of short licences, as their authors publish them.
TEMPLATES = [
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def longest_window(text: str, least: float = DICE) -> int:
    """Bigrams, repeated ones included, of the longest window for a template: as many as a match has at most."""
    return bounds(len(re.sub(r"[\W_]+", " ", text.lower()).split()) - 1, least)[1]


def bounds(size: int, least: float = DICE) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of `size`."""
    low = size * least / (2 - least)
    return int(-(-low // 1)), int(size * (2 - least) / least)


def anchors(templates: list[tuple[str, str]], least: float = DICE) -> list[str]:
    """Words of which every possible match holds one.

    A match shares at least least / (2 - least) of the template's bigrams; words
    are chosen until the bigrams without any of them are fewer.
    """
    sets = [template_bigrams(t) for _, t in templates]
    common = Counter(w for s in sets for w in {w for b in s for w in b.split()})
    chosen: list[str] = []
    for own in sets:
        shared = bounds(len(own), least)[0]
        words = sorted({w for b in own for w in b.split()}, key=lambda w: (w not in chosen, -(len(w) > 5), -common[w], -len(w), w))
        for w in words:
            if sum(not any(x in chosen for x in b.split()) for b in own) < shared:
                break
            if w not in chosen:
                chosen.append(w)
    return sorted(chosen)


def bigrams(unit: Column) -> Column:
    """Word bigrams of a normalised unit in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


#: A match; the least one is the best: of equally good ones that with most bigrams, then the first by name.
MATCH = "array<struct<minus_dice:double,minus_size:int,license:string>>"


def _match(unit: Column, template: Column) -> Column:
    shared, size = F.size(F.array_intersect(unit, template.grams)), F.size(template.grams)
    dice = shared * -2 / (F.size(F.array_distinct(unit)) + size)
    return F.struct(dice.alias("minus_dice"), (-size).alias("minus_size"), template.license.alias("license"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of an array that is made once: an element of an array is, whatever names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _met_before(grams: Column, span: Column) -> Column:
    """For each bigram, numbered from 1, the last place before it of an equal one less than `span` away; 0 without one."""

    def last(gram: Column, at: Column) -> Column:
        back = F.reverse(F.slice(grams, F.greatest(at + 2 - span, F.lit(1)), F.least(at, span - 1)))
        return _once(F.array_position(back, gram).cast("int"), lambda p: F.when(p > 0, at + 1 - p).otherwise(0))

    return F.transform(grams, last)


def window_matches(grams: Column, templates: Column, least: float = DICE) -> Column:
    """MATCH: of every bigram that begins a match of a window the best template.

    A window begins with a bigram of its template, as without another one it is no worse, and has at most its template's
    longest_window. Templates of which the text holds fewer bigrams than a match needs are passed over.
    """
    near = F.filter(templates, lambda t: F.size(F.array_intersect(grams, t.grams)) >= t.low)
    whole = F.size(grams)

    def found(near: Column) -> Column:
        span = F.array_max(F.transform(near, lambda t: t.span))
        marked = F.transform(near, lambda t: F.struct(t.license.alias("license"), t.span.alias("span"), F.size(t.grams).alias("size"), F.transform(grams, lambda g: F.array_contains(t.grams, g)).alias("own")))

        def scored(before: Column, marked: Column) -> Column:
            def best(t: Column, i: Column) -> Column:
                def grow(x: Column, k: Column) -> Column:
                    new = F.get(before, k - 1) < i
                    distinct = x["distinct"] + F.when(new, 1).otherwise(0)
                    shared = x["shared"] + F.when(new & F.get(t.own, k - 1), 1).otherwise(0)
                    return F.struct(distinct.alias("distinct"), shared.alias("shared"), F.least(x["best"], shared * -2 / (distinct + t.size)).alias("best"))

                none = F.struct(F.lit(0).alias("distinct"), F.lit(0).alias("shared"), F.lit(0.0).alias("best"))
                dice = F.aggregate(F.sequence(i, F.least(whole, i + t.span - 1)), none, grow, lambda x: x["best"])
                return F.when(F.get(t.own, i - 1), F.struct(dice.alias("minus_dice"), (-t.size).alias("minus_size"), t.license.alias("license")))

            of = F.transform(F.sequence(F.lit(1), whole), lambda i: F.array_min(F.transform(marked, lambda t: best(t, i))))
            return F.array_distinct(F.filter(of, lambda m: F.coalesce(m.minus_dice <= -least, F.lit(False))))

        return _once(_met_before(grams, span), lambda before: _once(marked, lambda m: scored(before, m)))

    return F.flatten(F.transform(F.filter(F.array(near), lambda n: F.size(n) > 0), found))


def matches(text: Column, templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE) -> Column:
    """MATCH: the best match of every unit that has one."""
    known = "(?i)(?<![\\p{L}\\p{N}])(?:" + "|".join(anchors(templates, least)) + ")(?![\\p{L}\\p{N}])"
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))
    some = F.filter(units, lambda u: F.rlike(u, F.lit(known)))
    rows = []
    for name, template in templates:
        grams = template_bigrams(template)
        low, high = bounds(len(grams), least)
        rows.append(
            F.struct(
                F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"),
                F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(longest_window(template, least)).alias("span"),
            )
        )
    listed = F.array(*rows)

    def best(own: Column) -> Column:
        fits = F.filter(listed, lambda t: F.size(own).between(t.low, t.high))
        return F.array_min(F.transform(fits, lambda t: _match(own, t)))

    whole = F.transform(F.transform(some, lambda u: F.array_distinct(bigrams(u))), best)
    whole = F.filter(whole, lambda m: F.coalesce(m.minus_dice <= -least, F.lit(False)))
    # The whole text's bigrams are made once, as the only element of an array.
    windows = F.flatten(F.transform(F.array(bigrams(text)), lambda g: window_matches(g, listed, least)))
    return F.when(F.rlike(text, F.lit(known)), F.concat(whole, windows)).otherwise(F.array().cast(MATCH))


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, license and dice of the best match, all licences found, for every document.

    No match: license null, dice 0, licenses empty. Null text counts as empty.
    Of equal coefficients the larger template's is taken, then the licence first by name. Repeated rows repeat;
    extra columns are not read; an empty table gives no rows. Texts may be of any length.
    """
    found = documents.select("doc_id", matches(F.coalesce("text", F.lit(""))).alias("m"))
    first = F.array_min("m")
    return found.select(
        "doc_id",
        first.license.alias("license"),
        F.round(F.coalesce(-first.minus_dice, F.lit(0.0)), 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m.license))), ",").alias("licenses"),
    )


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE) -> str:
    """The same result in DuckDB's SQL, comparing all units with all templates."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for name, template in templates:
        grams = template_bigrams(template)
        low, high = bounds(len(grams), least)
        rows.append(f"({quoted(name)}, [{', '.join(map(quoted, grams))}], {low}, {high}, {longest_window(template, least)})")
    normal = lambda s: rf"string_split(trim(regexp_replace(lower({s}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    dice = lambda g: f"2.0 * len(list_intersect({g}, grams)) / (len(list_distinct({g})) + len(grams))"
    return rf"""
WITH templates(license, grams, low, high, span) AS (VALUES {", ".join(rows)}),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
units AS (
    SELECT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n\s*\n'), [t]))) AS u
    FROM docs
), words AS (
    SELECT doc_id, {normal("u")} AS w FROM units
), own AS (
    SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words
), scored AS (
    SELECT doc_id, g, license, {dice("g")} AS dice, -len(grams) AS size FROM own JOIN templates ON len(g) BETWEEN low AND high
), texts AS (
    SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS all_grams FROM (SELECT doc_id, {normal("t")} AS w FROM docs)
), near AS (
    SELECT texts.*, templates.* FROM texts JOIN templates ON len(list_intersect(all_grams, grams)) >= low
), placed AS (
    SELECT doc_id, gram, k, coalesce(lag(k) OVER (PARTITION BY doc_id, gram ORDER BY k), 0) AS before
    FROM (SELECT doc_id, unnest(all_grams) AS gram, unnest(range(1, len(all_grams) + 1)) AS k FROM (SELECT DISTINCT doc_id, all_grams FROM near))
), own_grams AS (
    SELECT license, -len(grams) AS size, span, unnest(grams) AS gram FROM templates
), starts AS (
    SELECT doc_id, k AS i, near.license, -len(near.grams) AS size, near.span
    FROM near JOIN placed USING (doc_id) JOIN own_grams o ON o.gram = placed.gram AND o.license = near.license AND o.size = -len(near.grams)
), grown AS (
    SELECT s.doc_id, s.i, s.license, s.size, sum((p.before < s.i)::INT) OVER w AS n, sum((p.before < s.i AND o.gram IS NOT NULL)::INT) OVER w AS shared
    FROM starts s JOIN placed p ON p.doc_id = s.doc_id AND p.k BETWEEN s.i AND s.i + s.span - 1
    LEFT JOIN own_grams o ON o.gram = p.gram AND o.license = s.license AND o.size = s.size
    WINDOW w AS (PARTITION BY s.doc_id, s.license, s.size, s.i ORDER BY p.k)
), windows AS (
    SELECT doc_id, i, license, size, max(2.0 * shared / (n - size)) AS dice FROM grown GROUP BY ALL
), best AS (
    SELECT doc_id, arg_min(license, (-dice, size, license)) AS license, max(dice) AS dice, arg_min(size, (-dice, size, license)) AS size FROM (
        SELECT doc_id, g, 0 AS i, license, dice, size FROM scored
        UNION ALL SELECT doc_id, [], i, license, dice, size FROM windows
    ) GROUP BY doc_id, g, i
)
SELECT doc_id, arg_min(license, (-dice, size, license)) AS license,
    round(coalesce(max(dice), 0)::DOUBLE, 6) AS dice,
    coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM docs LEFT JOIN (SELECT * FROM best WHERE dice >= {least}) USING (doc_id) GROUP BY doc_id
"""
