"""Licence scan: passages against templates by Dice coefficient of word bigrams.

Texts and templates are normalised (lower case, words of letters and digits); line
ends, comment signs and punctuation vanish. A passage is a window of a template's
length, cut back to the first and last bigram that the template has, and is compared
by 2 * shared / (bigrams of the one + bigrams of the other), over sets of bigrams. So
a notice is found within a line, within prose, or wrapped over lines.

Sizes alone bound the coefficient: a match shares at least 7/13 of the template's
bigrams. So it has one of any of them that leave fewer than that out, which are
the template's seeds, and a window is laid only where a seed is, so that the seed
stands in its place. A passage with fewer or more distinct bigrams than could match
is not compared.

Passages that match and overlap are one notice. It carries the licence of greatest
coefficient, of equal ones the longer template, then the first name. A document
carries the notice of greatest coefficient, of equal ones the first name.

Edge cases: a null or empty text has no passage, a text of one word no bigram.
Repeated rows are rows of their own; null ids stay; an empty table gives no rows.
Columns but doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import let, text_of

#: Least coefficient of a match, in thousandths.
LEAST_DICE = 700

# Public licence notices, openings and whole texts, by short name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        ' software and associated documentation files (the "Software"), to deal in the Software'
        " without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons"
        " to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a"
        " copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials"
        " provided with the distribution."
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS'
        " OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
        " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
        " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,"
        " EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
        " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
        " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
        " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
        " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO'
        " THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT"
        " SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR"
        " ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
        " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE"
        " OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        ' software and associated documentation files (the "Software"), to deal in the Software'
        " without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons"
        " to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
        " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will"
        " the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial"
        " applications, and to alter it and redistribute it freely, subject to the following"
        " restrictions: 1. The origin of this software must not be misrepresented; you must not claim"
        " that you wrote the original software. If you use this software in a product, an"
        " acknowledgment in the product documentation would be appreciated but is not required."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented"
        " as being the original software. 3. This notice may not be removed or altered from any"
        " source distribution."
    ),
}


def size_bounds(size: int) -> tuple[int, int]:
    """Least and most distinct bigrams of a passage that could match this many."""
    least = -(-size * LEAST_DICE // (2000 - LEAST_DICE))
    return least, size * (2000 - LEAST_DICE) // LEAST_DICE


class Template:
    """A template, which is plain ASCII, with its bigrams and seeds."""

    def __init__(self, name: str, text: str) -> None:
        self.name = name
        self.words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        self.pairs = [f"{a} {b}" for a, b in zip(self.words, self.words[1:], strict=False)]

    @cached_property
    def bigrams(self) -> list[str]:
        """The distinct ones."""
        return sorted(set(self.pairs))

    @cached_property
    def bounds(self) -> tuple[int, int]:
        """Least and most bigrams of a match; the least is also how many it shares."""
        return size_bounds(len(self.bigrams))

    @cached_property
    def seeds(self) -> list[tuple[str, int]]:
        """(bigram, place) of so many bigrams that every match has one of them.

        Those that stand once in the template, and long ones, are rare in texts.
        """
        times = Counter(self.pairs)
        rare = sorted(times, key=lambda g: (times[g], -len(g), g))
        chosen = set(rare[: len(rare) - self.bounds[0] + 1])
        return [(g, at) for at, g in enumerate(self.pairs) if g in chosen]


def parsed(templates: dict[str, str]) -> list[Template]:
    """Templates ready to be held against texts; one without a bigram matches nothing."""
    return [t for t in (Template(name, text) for name, text in templates.items()) if t.pairs]


def _listed(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def _bigrams(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")

    def pairs(w: Column) -> Column:
        count = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, count), F.slice(w, 2, count), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(words, pairs)


def _places(bigrams: Column, wanted: list[str]) -> Column:
    """(place, gram) of the bigrams that are among the wanted ones."""
    marked = F.transform(
        bigrams, lambda g, i: F.when(g.isin(wanted), F.struct(i.alias("place"), g.alias("gram")))
    )
    return F.filter(marked, lambda m: m.isNotNull())


def _passage(template: Template, bigrams: Column, start: Column) -> Column:
    """The window that starts there as (begins, ends, minus, shorter, license), null if it is no match."""
    least, most = template.bounds

    def compared(window: Column, held: Column) -> Column:
        first = F.get(held, F.lit(0))["place"]
        last = F.element_at(held, -1)["place"]

        def scored(passage: Column) -> Column:
            shared = F.size(F.array_intersect(passage, _listed(template.bigrams)))
            dice = F.floor(2000 * shared / (F.size(passage) + len(template.bigrams))).cast("int")
            match = F.struct(
                (start + first).alias("begins"),
                (start + last + 2).alias("ends"),
                (-dice).alias("minus"),
                F.lit(-len(template.bigrams)).alias("shorter"),
                F.lit(template.name).alias("license"),
            )
            return F.when(F.size(passage).between(least, most) & (dice >= LEAST_DICE), match)

        cut = F.array_distinct(F.slice(window, first + 1, last - first + 1))
        return F.when(F.size(held) >= least, let(cut, scored))

    return let(
        F.slice(bigrams, start + 1, len(template.pairs)),
        lambda window: let(_places(window, template.bigrams), lambda held: compared(window, held)),
    )


def _matches(template: Template, bigrams: Column, seeds: Column) -> Column:
    """All passages that match a template."""
    own = F.expr("array(" + ", ".join(f"named_struct('gram', '{g}', 'at', {at})" for g, at in template.seeds) + ")")
    grams = sorted({g for g, _ in template.seeds})

    def starts(seed: Column) -> Column:
        places = F.filter(own, lambda s: s["gram"] == seed["gram"])
        return F.transform(places, lambda s: F.greatest(seed["place"] - s["at"], F.lit(0)))

    laid = F.array_distinct(F.flatten(F.transform(F.filter(seeds, lambda s: s["gram"].isin(grams)), starts)))
    return F.filter(F.transform(laid, lambda start: _passage(template, bigrams, start)), lambda m: m.isNotNull())


def _notices(matches: Column) -> Column:
    """(best, notices) of matching passages: those that overlap are one notice."""
    top, best = "struct<minus:int,shorter:int,license:string>", "struct<minus:int,license:string>"

    def named(t: Column) -> Column:
        return F.when(t.isNotNull(), F.struct(t["minus"].alias("minus"), t["license"].alias("license")))

    def joined(seen: Column, m: Column) -> Column:
        apart = m["begins"] >= seen["until"]
        this = F.struct(m["minus"].alias("minus"), m["shorter"].alias("shorter"), m["license"].alias("license"))
        return F.struct(
            (seen["notices"] + apart.cast("int")).alias("notices"),
            F.greatest(seen["until"], m["ends"]).alias("until"),
            F.when(apart, this).otherwise(F.least(seen["top"], this)).alias("top"),
            F.when(apart, F.least(seen["best"], named(seen["top"]))).otherwise(seen["best"]).alias("best"),
        )

    none = F.struct(
        F.lit(0).alias("notices"),
        F.lit(0).alias("until"),
        F.lit(None).cast(top).alias("top"),
        F.lit(None).cast(best).alias("best"),
    )
    return F.aggregate(
        F.array_sort(matches),
        none,
        joined,
        lambda seen: F.struct(
            F.least(seen["best"], named(seen["top"])).alias("best"), seen["notices"].alias("notices")
        ),
    )


def matches(text: Column, templates: dict[str, str]) -> Column:
    """(best, notices): the best match of a text and the number of its notices.

    A match is (minus, license); ``minus`` is the coefficient with the sign changed,
    so the least is the best. Null for a text without any seed.
    """
    held = parsed(templates)
    wanted = sorted({g for t in held for g, _ in t.seeds})

    def found(bigrams: Column, seeds: Column) -> Column:
        every = F.flatten(F.array(*[_matches(t, bigrams, seeds) for t in held]))
        return F.when(F.size(seeds) > 0, _notices(every))

    return let(_bigrams(text), lambda b: let(_places(b, wanted), lambda seeds: found(b, seeds)))


def license_table(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: best licence, its coefficient in thousandths, number of notices.

    Each row is judged where it is read; nothing is shuffled.
    """
    found = matches(text_of(F.col("text")), templates)
    return docs.select("doc_id", found.alias("found")).select(
        "doc_id",
        F.col("found.best.license").alias("license"),
        (-F.col("found.best.minus")).cast("long").alias("dice"),
        F.coalesce(F.col("found.notices"), F.lit(0)).cast("long").alias("n_passages"),
    )
