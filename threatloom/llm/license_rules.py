"""The licence rules: what names each licence, and the ways in which texts point to one."""

from __future__ import annotations

import re
from dataclasses import dataclass

# fixed values: licence, a word that any of its names holds, its names in running words
NAMES = (
    ("0bsd", "zero", r"zero clause bsd"),
    ("afl-3.0", "academic", r"academic free license(?: (?:version |v ?)?3 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: (?:version |v ?)?3(?: 0)?)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v ?)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v ?)?2(?: 0)?"),
    ("apsl-2.0", "apple", r"apple public source license"),
    ("artistic-1.0", "artistic", r"artistic license (?:version )?1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version )?2 0"),
    ("beerware", "license", r"beer ?ware license"),
    ("blueoak-1.0.0", "oak", r"blue oak model license"),
    ("bsd-2-clause", "bsd", r"(?:simplified|two clause|2 clause|freebsd) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|three clause|3 clause) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:original|four clause|4 clause) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version )?1 0)?"),
    ("busl-1.1", "business", r"business source license(?: 1 1)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-3.0", "creative", r"creative commons attribution 3 0(?: unported)?(?: license)?"),
    ("cc-by-4.0", "creative", r"creative commons attribution 4 0(?: international)?(?: license)?"),
    ("cc-by-nc-4.0", "noncommercial", r"creative commons attribution noncommercial 4 0(?: international)?"),
    ("cc-by-nc-sa-4.0", "noncommercial", r"creative commons attribution noncommercial sharealike 4 0"),
    ("cc-by-nc-nd-4.0", "noncommercial", r"creative commons attribution noncommercial noderivatives 4 0"),
    ("cc-by-nd-4.0", "noderivatives", r"creative commons attribution noderivatives 4 0"),
    ("cc-by-sa-3.0", "commons", r"creative commons attribution share ?alike 3 0"),
    ("cc-by-sa-4.0", "commons", r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cddl-1.0", "common", r"common development and distribution license(?: (?:version )?1 0)?"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? license(?: agreement)?"),
    ("cpal-1.0", "attribution", r"common public attribution license"),
    ("cpl-1.0", "common", r"common public license(?: (?:version )?1 0)?"),
    ("ecl-2.0", "educational", r"educational community license(?: (?:version )?2 0)?"),
    ("efl-2.0", "eiffel", r"eiffel forum license"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v ?)?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v ?)?2 0"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: (?:version |v ?)?1 2)?"),
    ("fsl-1.1", "functional", r"functional source license"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation license(?: (?:version )?1 3)?"),
    ("gpl-1.0", "general", r"(?:gnu )?general public license (?:version |v ?)?1(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license (?:version |v ?)?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license (?:version |v ?)?3(?: 0)?"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("icu", "icu", r"icu license"),
    ("ipl-1.0", "ibm", r"ibm public license"),
    ("isc", "isc", r"isc license"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license (?:version |v ?)?2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license (?:version |v ?)?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?"),
    ("libpng", "libpng", r"libpng license"),
    ("llama-2", "llama", r"llama 2 community license(?: agreement)?"),
    ("llama-3", "llama", r"(?:meta )?llama 3 community license(?: agreement)?"),
    ("lppl-1.3c", "latex", r"latex project public license"),
    ("mit-0", "mit", r"mit no attribution(?: license)?"),
    ("mit", "mit", r"(?:the )?mit license"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v ?)?2 0"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("nposl-3.0", "non", r"non profit open software license"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license"),
    ("odc-by-1.0", "commons", r"open data commons attribution license"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: (?:version )?1 1)?"),
    ("openssl", "openssl", r"openssl license"),
    ("openrail", "rail", r"(?:creativeml )?open rail m? ?license"),
    ("osl-3.0", "open", r"open software license(?: (?:version |v ?)?3 0)?"),
    ("parity-7.0.0", "parity", r"parity public license"),
    ("php-3.01", "php", r"php license(?: (?:version )?3 01)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("psf-2.0", "python", r"python software foundation license(?: (?:version )?2)?"),
    ("qpl-1.0", "q", r"q public license"),
    ("ruby", "ruby", r"ruby license"),
    ("sspl-1.0", "server", r"server side public license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("upl-1.0", "universal", r"universal permissive license"),
    ("vim", "vim", r"vim license"),
    ("w3c", "w3c", r"w3c software (?:notice and )?license"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("x11", "x11", r"x11 license"),
    ("zlib", "zlib", r"zlib license"),
    ("zpl-2.1", "zope", r"zope public license"),
)

# fixed values: label, a word that must occur, sentence from the licence or a notice
SENTENCES = (
    ("mit", "merge", r"to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement"),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3-clause", "endorse", r"used to endorse or promote products derived from this software"),
    ("bsd-2-clause", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gpl-or-later", "later", r"(?:version [123](?: 0)? of the license )?or at your option any later version"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to(?: public license)?"),
    ("bsl-1.0", "executable", r"machine executable object code generated by a source language processor"),
    ("public-domain", "domain", r"(?:released into|dedicated to|placed in|is in) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|document|material)"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("no-ai-training", "training", r"may not be used (?:for|in) (?:the )?training (?:of )?(?:ai|machine learning)"),
    ("see-license-file", "file", r"see (?:the )?(?:license|licence|copying) file for"),
)

# fixed values: label, a word that must occur, words of an address
ADDRESSES = (
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("mit", "mit", r"opensource org licenses? mit"),
    ("bsd-3-clause", "bsd", r"opensource org licenses? bsd 3 clause"),
    ("gpl", "gnu", r"gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", "gnu", r"gnu org (?:licenses|copyleft) lgpl"),
    ("agpl", "gnu", r"gnu org (?:licenses|copyleft) agpl"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("cc-by-4.0", "creativecommons", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons", r"creativecommons org licenses by nc 4 0"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("unlicense", "unlicense", r"unlicense org"),
)

# fixed values: the phrases every scan reports, never suppressed
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


@dataclass(frozen=True)
class Rule:
    """Of two detections the one of the earlier rule suppresses the other, if it contains it."""

    name: str
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    score: float
    base: bool = False


def rules() -> list[Rule]:
    """All rules, the most specific ways of pointing to a licence first."""
    found: list[Rule] = []

    def add(kind: str, label: str, keyword: str, pattern: str, score: float, base: bool = False) -> None:
        compiled = re.compile(rf" (?:{pattern})(?= )".encode())
        found.append(Rule(f"{kind}:{label}:{len(found)}", label, f" {keyword} ".encode(), compiled, len(found), score, base))

    for label, _, _ in NAMES:
        words = " ".join(re.findall("[a-z0-9]+", label))
        add("identifier", label, "identifier", rf"spdx license identifier {words}(?: (?:only|or later))?", 1.0)
    for label, keyword, names in NAMES:
        add("notice", label, keyword, rf"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:{names})", 0.95)
    for label, keyword, names in NAMES:
        add("grant", label, keyword, rf"(?:distributed|released|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names})", 0.9)
    for label, keyword, sentence in SENTENCES:
        add("sentence", label, keyword, sentence, 0.5 if label in ("all-rights-reserved", "copyright") else 0.85)
    for label, keyword, address in ADDRESSES:
        add("address", label, keyword, address, 0.8)
    for label, keyword, names in NAMES:
        add("name", label, keyword, names, 0.6)
    for label, phrase in PHRASES:
        add("phrase", label, phrase.split()[0], phrase, 0.55, base=True)
    return found
