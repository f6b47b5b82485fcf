"""Licence scan by ordered signature rules over the words of a text.

A rule is a regex for the words from one place on; its first word is its keyword. Words that are a keyword gate
everything else, so texts without one cost a few substring tests. At a place the rule with the highest priority,
then the longest match, wins. A detection is suppressed if its interval of words lies inside that of a detection
of higher priority, or of a longer one of equal priority. Only DataFrame functions; each row is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words read from a place; no rule is longer.
SPAN = 24
#: Fixed values of the contract: the words of a phrase, its label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Priority, label and regex of each rule, over words with single blanks between them. The first word is plain: it is the keyword.
RULES = r"""
30 mit|mit licen[cs]e
30 mit|mit x11 licen[cs]e
30 mit|mit style licen[cs]e
30 mit|expat licen[cs]e
30 x11|x11 licen[cs]e
97 mit|permission is hereby granted free of charge to any person obtaining a copy
60 mit|the software is provided as is without warranty of any kind express or implied
60 mit|above copyright notice and this permission notice shall be included in all copies
30 apache|apache licen[cs]e
30 apache|apache software licen[cs]e
45 apache-2.0|apache 2 0
45 apache-2.0|apache 2 licen[cs]e
45 apache-2.0|apache licen[cs]e 2 0
45 apache-2.0|apache licen[cs]e v2(?: 0)?
45 apache-2.0|apache licen[cs]e version 2 0
45 apache-2.0|apache software licen[cs]e (?:version )?2 0
45 apache-1.1|apache 1 1
45 apache-1.1|apache licen[cs]e (?:version )?1 1
45 apache-1.1|apache software licen[cs]e (?:version )?1 1
45 apache-1.0|apache (?:software )?licen[cs]e (?:version )?1 0
90 apache-2.0|you may not use this file except in compliance with the licen[cs]e
30 gpl|gpl
30 gpl|gnu gpl
30 gpl|gnu public licen[cs]e
30 gpl|gnu general public licen[cs]e
30 gpl|general public licen[cs]e
45 gpl-1.0|gpl v?1(?: 0)?(?: only| or later)?
45 gpl-2.0|gpl v?2(?: 0)?(?: only| or later)?
45 gpl-2.0|gplv2
45 gpl-2.0|gnu gpl (?:version )?v?2(?: 0)?
45 gpl-2.0|gnu general public licen[cs]e (?:gpl )?(?:version )?v?2(?: 0)?
45 gpl-2.0|general public licen[cs]e (?:gpl )?(?:version )?v?2(?: 0)?
45 gpl-3.0|gpl v?3(?: 0)?(?: only| or later)?
45 gpl-3.0|gplv3
45 gpl-3.0|gnu gpl (?:version )?v?3(?: 0)?
45 gpl-3.0|gnu general public licen[cs]e (?:gpl )?(?:version )?v?3(?: 0)?
45 gpl-3.0|general public licen[cs]e (?:gpl )?(?:version )?v?3(?: 0)?
88 gpl|this program is free software you can redistribute it and or modify it
70 gpl|free software foundation either version [123] of the licen[cs]e
70 gpl|you should have received a copy of the gnu general public licen[cs]e
30 lgpl|lgpl
30 lgpl|gnu lgpl
30 lgpl|gnu lesser general public licen[cs]e
30 lgpl|gnu library general public licen[cs]e
30 lgpl|lesser general public licen[cs]e
30 lgpl|library general public licen[cs]e
45 lgpl-2.0|lgpl v?2 0(?: only| or later)?
45 lgpl-2.0|gnu library general public licen[cs]e (?:version )?v?2(?: 0)?
45 lgpl-2.1|lgpl v?2 1(?: only| or later)?
45 lgpl-2.1|lgplv2 1
45 lgpl-2.1|gnu lesser general public licen[cs]e (?:lgpl )?(?:version )?v?2 1
45 lgpl-2.1|lesser general public licen[cs]e (?:lgpl )?(?:version )?v?2 1
45 lgpl-3.0|lgpl v?3(?: 0)?(?: only| or later)?
45 lgpl-3.0|lgplv3
45 lgpl-3.0|gnu lesser general public licen[cs]e (?:lgpl )?(?:version )?v?3(?: 0)?
45 lgpl-3.0|lesser general public licen[cs]e (?:lgpl )?(?:version )?v?3(?: 0)?
88 lgpl|this library is free software you can redistribute it and or modify it
30 agpl|agpl
30 agpl|gnu agpl
30 agpl|gnu affero general public licen[cs]e
30 agpl|affero general public licen[cs]e
45 agpl-3.0|agpl v?3(?: 0)?(?: only| or later)?
45 agpl-3.0|agplv3
45 agpl-3.0|gnu affero general public licen[cs]e (?:agpl )?(?:version )?v?3(?: 0)?
45 agpl-3.0|affero general public licen[cs]e (?:agpl )?(?:version )?v?3(?: 0)?
30 gfdl|gfdl
30 gfdl|gnu fdl
30 gfdl|gnu free documentation licen[cs]e
30 gfdl|free documentation licen[cs]e
45 gfdl-1.2|gfdl 1 2(?: only| or later)?
45 gfdl-1.3|gfdl 1 3(?: only| or later)?
45 gfdl-1.2|gnu free documentation licen[cs]e version 1 2
45 gfdl-1.3|gnu free documentation licen[cs]e version 1 3
30 bsd|bsd licen[cs]e
30 bsd|bsd style licen[cs]e
30 bsd|berkeley software distribution
45 0bsd|0bsd
45 0bsd|zero clause bsd
45 0bsd|bsd zero clause
45 bsd-2-clause|bsd 2 clause(?: licen[cs]e)?
45 bsd-2-clause|2 clause bsd(?: licen[cs]e)?
45 bsd-2-clause|two clause bsd(?: licen[cs]e)?
45 bsd-2-clause|simplified bsd(?: licen[cs]e)?
45 bsd-2-clause|freebsd licen[cs]e
45 bsd-3-clause|bsd 3 clause(?: licen[cs]e)?
45 bsd-3-clause|3 clause bsd(?: licen[cs]e)?
45 bsd-3-clause|three clause bsd(?: licen[cs]e)?
45 bsd-3-clause|new bsd(?: licen[cs]e)?
45 bsd-3-clause|modified bsd(?: licen[cs]e)?
45 bsd-3-clause|revised bsd(?: licen[cs]e)?
45 bsd-4-clause|bsd 4 clause(?: licen[cs]e)?
45 bsd-4-clause|4 clause bsd(?: licen[cs]e)?
45 bsd-4-clause|original bsd(?: licen[cs]e)?
97 bsd|redistribution and use in source and binary forms
80 bsd|redistributions of source code must retain the above copyright notice
80 bsd|redistributions in binary form must reproduce the above copyright notice
85 bsd-3-clause|neither the name of .{1,80} nor the names of its contributors may be used to endorse
85 bsd-4-clause|all advertising materials mentioning features or use of this software must display
30 isc|isc licen[cs]e
97 isc|permission to use copy modify and (?:or )?distribute this software for any purpose
30 mpl|mpl
30 mpl|mozilla public licen[cs]e
45 mpl-1.1|mpl v?1 1
45 mpl-1.1|mozilla public licen[cs]e (?:mpl )?(?:version )?v?1 1
45 mpl-2.0|mpl v?2 0
45 mpl-2.0|mozilla public licen[cs]e (?:mpl )?(?:version )?v?2 0
95 mpl-2.0|this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
30 epl|eclipse public licen[cs]e
45 epl-1.0|epl v?1 0
45 epl-1.0|eclipse public licen[cs]e (?:version )?v?1 0
45 epl-2.0|epl v?2 0
45 epl-2.0|eclipse public licen[cs]e (?:version )?v?2 0
30 cpl|common public licen[cs]e
30 cddl|cddl
30 cddl|common development and distribution licen[cs]e
45 cddl-1.0|cddl 1 0
45 cddl-1.1|cddl 1 1
45 cddl-1.0|common development and distribution licen[cs]e (?:cddl )?(?:version )?1 0
30 eupl|european union public licen[cs]e
45 eupl-1.1|eupl v?1 1
45 eupl-1.2|eupl v?1 2
45 eupl-1.2|european union public licen[cs]e (?:version )?v?1 2
35 cc0|cc0
35 cc0|cc zero
35 cc0|creative commons zero
35 cc0|creative commons cc0
45 cc0|cc0 1 0(?: universal)?
30 cc|creative commons licen[cs]e
35 cc-by|cc by
35 cc-by|creative commons attribution
40 cc-by-sa|cc by sa
40 cc-by-sa|creative commons attribution share ?alike
40 cc-by-nd|cc by nd
40 cc-by-nd|creative commons attribution no ?deriv(?:ative)?s?
40 cc-by-nc|cc by nc
40 cc-by-nc|creative commons attribution non ?commercial
45 cc-by-nc-sa|cc by nc sa
45 cc-by-nc-sa|creative commons attribution non ?commercial share ?alike
45 cc-by-nc-nd|cc by nc nd
45 cc-by-nc-nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?
50 cc-by|creativecommons org licen[cs]es by
52 cc-by-sa|creativecommons org licen[cs]es by sa
52 cc-by-nd|creativecommons org licen[cs]es by nd
52 cc-by-nc|creativecommons org licen[cs]es by nc
54 cc-by-nc-sa|creativecommons org licen[cs]es by nc sa
54 cc-by-nc-nd|creativecommons org licen[cs]es by nc nd
54 cc0|creativecommons org publicdomain zero
54 public-domain|creativecommons org publicdomain mark
30 unlicense|unlicense
97 unlicense|this is free and unencumbered software released into the public domain
30 wtfpl|wtfpl
30 wtfpl|do what the \w+ you want to public licen[cs]e
30 zlib|zlib licen[cs]e
30 zlib|zlib libpng licen[cs]e
90 zlib|this software is provided as is without any express or implied warranty
30 boost|boost software licen[cs]e
45 boost|boost software licen[cs]e (?:version )?1 0
45 boost|bsl 1 0 licen[cs]e
90 boost|permission is hereby granted free of charge to any person or organization obtaining a copy
30 artistic|artistic licen[cs]e
45 artistic-1.0|artistic licen[cs]e (?:version )?1 0
45 artistic-2.0|artistic licen[cs]e (?:version )?2 0
30 perl|same terms as perl itself
30 psf|psf licen[cs]e
30 psf|python licen[cs]e
30 psf|python software foundation licen[cs]e
45 psf-2.0|python software foundation licen[cs]e version 2
30 php|php licen[cs]e
45 php-3.01|php licen[cs]e (?:version )?3 01
30 ruby|ruby licen[cs]e
30 ofl|open font licen[cs]e
30 ofl|sil open font licen[cs]e
45 ofl-1.1|open font licen[cs]e (?:version )?1 1
45 ofl-1.1|sil open font licen[cs]e (?:version )?1 1
30 odbl|odbl
30 odbl|open database licen[cs]e
30 odbl|open data commons open database licen[cs]e
30 odc-by|open data commons attribution licen[cs]e
30 pddl|open data commons public domain dedication and licen[cs]e
30 ogl|open government licen[cs]e
30 ogl|open game licen[cs]e
30 openssl|openssl licen[cs]e
30 postgresql|postgresql licen[cs]e
30 ncsa|ncsa open source licen[cs]e
30 ms-pl|microsoft public licen[cs]e
30 ms-rl|microsoft reciprocal licen[cs]e
30 afl|academic free licen[cs]e
30 osl|open software licen[cs]e
30 upl|universal permissive licen[cs]e
30 sspl|server side public licen[cs]e
30 busl|business source licen[cs]e
30 elastic|elastic licen[cs]e
30 commons-clause|commons clause licen[cs]e
30 openrail|open rail licen[cs]e
30 llama|community licen[cs]e agreement
40 public-domain|in the public domain
40 public-domain|into the public domain
40 public-domain|to the public domain
45 public-domain|released into the public domain
45 public-domain|placed in the public domain
45 public-domain|dedicated to the public domain
45 public-domain|public domain dedication
60 all-rights-reserved|all rights reserved
60 all-rights-reserved|alle rechte vorbehalten copyright
60 all-rights-reserved|tous droits réservés copyright
50 copyright-notice|copyright (?:c )?(?:19|20)\d\d
50 copyright-notice|copyright by .{1,60} (?:19|20)\d\d
50 copyright-notice|copyrighted (?:material|work|content)
40 proprietary|do not copy
40 proprietary|do not (?:distribute|redistribute)
70 proprietary|confidential and proprietary
70 proprietary|proprietary and confidential
30 proprietary|proprietary licen[cs]e
30 proprietary|proprietary software licen[cs]e
30 proprietary|commercial licen[cs]e
30 proprietary|commercial software licen[cs]e
50 proprietary|unauthorized (?:copying|reproduction|distribution|use) of this
50 proprietary|no part of this (?:publication|book|work|document) may be (?:copied|reproduced|distributed)
50 proprietary|may not be (?:copied|reproduced|redistributed|distributed) without (?:the )?(?:prior )?(?:written )?permission
50 proprietary|for personal use only copying
50 proprietary|not for (?:distribution|redistribution)
50 proprietary|end user licen[cs]e agreement
50 permissive|permission to copy and distribute
50 permissive|permission is granted to copy distribute and or modify this document
50 permissive|license to use copy modify merge publish distribute sublicen[cs]e
60 mit|licensed under (?:the )?(?:terms of )?(?:the )?mit
60 isc|licensed under (?:the )?(?:terms of )?(?:the )?isc
60 bsd|licensed under (?:the )?(?:terms of )?(?:a |the )?bsd
60 mit|released under (?:the )?(?:terms of )?(?:the )?mit
60 bsd|released under (?:the )?(?:terms of )?(?:a |the )?bsd
60 mit|distributed under (?:the )?(?:terms of )?(?:the )?mit
60 bsd|distributed under (?:the )?(?:terms of )?(?:a |the )?bsd
60 mit|available under (?:the )?(?:terms of )?(?:the )?mit
60 bsd|available under (?:the )?(?:terms of )?(?:a |the )?bsd
65 psf|licensed under (?:the )?psf
65 wtfpl|licensed under (?:the )?wtfpl
100 mit|spdx licen[cs]e identifier mit
100 mit-0|spdx licen[cs]e identifier mit 0
100 apache-2.0|spdx licen[cs]e identifier apache 2 0
100 apache-1.1|spdx licen[cs]e identifier apache 1 1
100 gpl-2.0|spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
100 gpl-3.0|spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
100 lgpl-2.1|spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
100 lgpl-3.0|spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
100 agpl-3.0|spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
100 gfdl|spdx licen[cs]e identifier gfdl 1 [123](?: only| or later)?
100 bsd-2-clause|spdx licen[cs]e identifier bsd 2 clause
100 bsd-3-clause|spdx licen[cs]e identifier bsd 3 clause
100 bsd-4-clause|spdx licen[cs]e identifier bsd 4 clause
100 0bsd|spdx licen[cs]e identifier 0bsd
100 isc|spdx licen[cs]e identifier isc
100 mpl-1.1|spdx licen[cs]e identifier mpl 1 1
100 mpl-2.0|spdx licen[cs]e identifier mpl 2 0
100 epl-1.0|spdx licen[cs]e identifier epl 1 0
100 epl-2.0|spdx licen[cs]e identifier epl 2 0
100 cddl-1.0|spdx licen[cs]e identifier cddl 1 0
100 eupl-1.2|spdx licen[cs]e identifier eupl 1 2
100 cc0|spdx licen[cs]e identifier cc0 1 0
100 cc-by|spdx licen[cs]e identifier cc by [1-4] [05]
100 cc-by-sa|spdx licen[cs]e identifier cc by sa [1-4] [05]
100 cc-by-nd|spdx licen[cs]e identifier cc by nd [1-4] [05]
100 cc-by-nc|spdx licen[cs]e identifier cc by nc [1-4] [05]
100 cc-by-nc-sa|spdx licen[cs]e identifier cc by nc sa [1-4] [05]
100 cc-by-nc-nd|spdx licen[cs]e identifier cc by nc nd [1-4] [05]
100 unlicense|spdx licen[cs]e identifier unlicense
100 wtfpl|spdx licen[cs]e identifier wtfpl
100 zlib|spdx licen[cs]e identifier zlib
100 boost|spdx licen[cs]e identifier bsl 1 0
100 artistic-2.0|spdx licen[cs]e identifier artistic 2 0
100 psf-2.0|spdx licen[cs]e identifier psf 2 0
100 ofl-1.1|spdx licen[cs]e identifier ofl 1 1
100 odbl|spdx licen[cs]e identifier odbl 1 0
100 proprietary|spdx licen[cs]e identifier licenseref \w+
"""
#: Parts of single words. Whatever a rule matches has one of them (a test proves it), so a text without any has no
#: place where a rule could hold, however its words are parted.
ROOTS = ("licen", "copy", "distribut", "permission", "rights", "domain", "commons", "apache", "gpl", "gfdl", "bsd", "berkeley", "mpl", "cc", "wtfpl", "cddl", "epl", "eupl", "odbl", "proprietary", "provided", "redistribut", "advertis", "names", "terms", "gnu", "unauthorized", "copied", "reproduc", "released", "available")


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, regex, label, priority) of every rule."""
    out = []
    for line in RULES.strip().splitlines():
        head, _, regex = line.partition("|")
        rank, label = head.split()
        out.append((regex.split(" ", 1)[0], regex, label, int(rank)))
    return out


def words_of(text: Column) -> Column:
    """The runs of word characters of a text already lower-cased."""
    return F.filter(F.split(text, NON_WORD), lambda w: w != "")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are counted from 0. n_base counts the places where a base phrase's words stand consecutively; first_word
    and last_word are their least and greatest start, null without any. labels also has those of the detections
    left after suppression (structs of start, end, label, priority; end exclusive); score is the highest priority
    among these and 0.8 for a base phrase, over 100. Null or empty text: no words, empty labels, score 0.
    Repeated rows and null ids pass through; other columns are ignored.
    """
    rows = docs.select("doc_id", lower_ascii(F.col("text")).alias("low"))
    rows = rows.select("doc_id", words_of(F.col("low")).alias("words"), _any_of(F.col("low"), ("license",)).alias("has_base"), _any_of(F.col("low"), ROOTS).alias("has_root"))
    gated = lambda flag, value, kind: F.when(F.col(flag), value).otherwise(F.array().cast(kind))
    word = lambda i: F.get("words", i)  # noqa: E731  null outside

    def base_at(i: Column) -> Column:
        """(start, label) of the base phrase whose last word stands at i."""
        found = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in BASE:
            parts = phrase.split()
            here = F.lit(True)
            for back, part in enumerate(reversed(parts[:-1]), 1):
                here = here & F.coalesce(word(i - back) == part, F.lit(False))
            found = F.when(here, F.struct((i - len(parts) + 1).cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    ends = F.filter(F.transform("words", lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("ends", gated("has_base", ends, "array<int>"))
    rows = rows.withColumn("base", F.filter(F.transform("ends", base_at), lambda x: x.isNotNull()))
    table = rules()
    keys = sorted({r[0] for r in table})
    at_key = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(keys), F.struct(i.alias("start"), w.alias("key")))), lambda x: x.isNotNull()
    )
    rows = rows.withColumn("places", gated("has_root", at_key, "array<struct<start:int,key:string>>"))
    def best(place: Column) -> Column:
        """The winning rule at a place, if any holds there. Patterns are literals, so that each is compiled once."""
        window = F.concat(F.array_join(F.slice("words", place["start"] + 1, F.lit(SPAN)), " "), F.lit(" "))
        found = F.lit(None).cast("struct<priority:int,length:int,label:string>")
        for key in keys:
            here = [r for r in table if r[0] == key]
            # A match ends where a word ends; the blank after it counts that word.
            length = lambda rx: F.length(F.regexp_replace(F.coalesce(F.regexp_substr(window, F.lit(rf"\A(?:{rx}) ")), F.lit("")), "[^ ]", ""))
            tried = F.array(*[F.struct(F.lit(rank).alias("priority"), length(rx).alias("length"), F.lit(label).alias("label")) for _, rx, label, rank in here])
            any_here = window.rlike(rf"\A(?:{'|'.join(rx for _, rx, _, _ in here)}) ")
            found = F.when(place["key"] == key, F.when(any_here, F.array_max(F.filter(tried, lambda t: t["length"] > 0)))).otherwise(found)
        return F.transform(F.array(found), lambda top: F.struct(place["start"].alias("start"), (place["start"] + top["length"]).alias("end"), top["label"].alias("label"), top["priority"].alias("priority")))[0]

    rows = rows.withColumn("raw", F.filter(F.transform("places", best), lambda d: d["end"].isNotNull()))

    def suppressed(d: Column, i: Column) -> Column:
        """Inside a stronger detection. Starts rise and spans are at most SPAN words, so only that many neighbours count."""
        near = F.slice("raw", F.greatest(i + 1 - SPAN, F.lit(1)), F.lit(2 * SPAN))
        size, rank = (lambda x: x["end"] - x["start"]), (lambda x: x["priority"])
        return F.exists(
            near,
            lambda o: (o["start"] <= d["start"]) & (o["end"] >= d["end"]) & ((rank(o) > rank(d)) | ((rank(o) == rank(d)) & (size(o) > size(d)))),
        )

    kept = F.filter("raw", lambda d, i: ~suppressed(d, i))
    rows = rows.withColumn("detections", kept)
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"]))))
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / F.lit(100.0),
        F.when(F.size("base") > 0, 0.8).otherwise(0.0),
    )
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.cast("double").alias("score"),
        "detections",
    )


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found
