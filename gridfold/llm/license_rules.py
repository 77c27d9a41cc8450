"""The signature rules of the licence scan, in their order.

A rule is a label, a keyword that stands in every text it matches, a regular expression over lower-case words
with single spaces, a priority (1 is best) and a weight. ``{L}`` is the word licence in its spellings, ``{V}``
a version; a label that ends in ``-`` takes the version that the match holds. Of two detections of the same
words and priority that of the earlier rule stays.
"""

from __future__ import annotations

L = "licen[cs]es?"
V = "(?: version| ver| v)? v?[0-9](?: [0-9]{1,2})?"
#: Signatures of licence texts, grants, headers, identifiers and names.
WRITTEN = [
    # Bodies of permissive licences.
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1, 1.0),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute", 1, 1.0),
    ("mit", "portions", "(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software", 1, 1.0),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 2, 0.9),
    ("mit-0", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1, 1.0),
    ("mit", "express or implied", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 2, 0.8),
    ("mit", "copyright holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 2, 0.8),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising", 1, 1.0),
    ("isc", "is hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1, 1.0),
    ("isc", "all warranties with regard", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 2, 0.8),
    ("0bsd", "is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1, 1.0),
    ("hpnd", "permission to use", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", 1, 1.0),
    ("ntp", "is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice", 1, 1.0),
    ("postgresql", "is hereby granted", "for any purpose without fee and without a written agreement is hereby granted", 1, 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1, 1.0),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.9),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 2, 0.9),
    ("bsd-3-clause", "endorse or promote", "neither the names? of .{1,80}?may be used to endorse or promote products derived from this software", 1, 1.0),
    ("bsd-3-clause", "endorse or promote", "the names? of .{1,60}?may not be used to endorse or promote products derived from this software", 1, 1.0),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 1, 1.0),
    ("bsd-3-clause-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted by this license", 1, 1.0),
    ("bsd", "express or implied warranties", "this software is provided by .{1,80}?as is and any express or implied warranties", 2, 0.8),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 1.0),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 1.0),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1, 1.0),
    ("zlib", "altered from any source", "this notice may not be removed or altered from any source distribution", 2, 0.9),
    ("libpng", "png", "the png reference library is supplied as is", 1, 1.0),
    ("bsl-1.0", "executable", "in the form of machine executable object code generated by a source language processor", 1, 1.0),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1, 1.0),
    ("ncsa", "with the software without restriction", "to deal with the software without restriction including without limitation the rights", 1, 1.0),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", "publish use compile", "anyone is free to copy modify publish use compile sell or distribute this software", 1, 1.0),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 1, 1.0),
    ("wtfpl", "fuck", f"do what the fuck you want to public {L}", 1, 1.0),
    ("beerware", "beer ware", f"beer ware {L}", 2, 0.9),
    ("json", "not evil", "the software shall be used for good not evil", 1, 1.0),
    ("curl", "is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1, 1.0),
    ("fsfap", "without royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty", 1, 1.0),
    ("fsful", "unlimited permission", "gives unlimited permission to copy and or distribute it with or without modifications", 1, 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1, 1.0),
    ("ssleay", "cryptographic software", "this product includes cryptographic software written by eric young", 1, 1.0),
    ("php", "php", "this product includes php software freely available from", 1, 1.0),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 1, 1.0),
    ("python", "python software foundation", f"python software foundation {L}{V}", 1, 1.0),
    ("cnri", "hereby grants", "corporation for national research initiatives hereby grants (?:licensee|you) a nonexclusive royalty free world wide", 1, 1.0),
    ("w3c", "w3c", f"w3c software (?:and document )?(?:notice and )?{L}", 1, 1.0),
    ("unicode", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files", 1, 1.0),
    ("ofl-1.1", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 1, 1.0),
    ("ofl-1.1", "reserved font name", "no modified version of the font software may use the reserved font names?", 1, 1.0),
    ("vim", "unmodified copies", "there are no restrictions on distributing unmodified copies of vim", 1, 1.0),
    ("imagemagick", "imagemagick", f"imagemagick {L}", 2, 0.9),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", 1, 1.0),
    ("freetype", "freetype", f"freetype (?:project )?{L}", 2, 0.9),
    ("icu", "icu", f"icu {L}(?: icu [0-9 ]{{1,8}}and later)?", 2, 0.9),
    ("tcl", "regents", "this software is copyrighted by the regents of the university of california", 1, 1.0),
    ("upl-1.0", "universal permissive", f"universal permissive {L}{V}", 1, 1.0),
    ("upl", "universal permissive", f"universal permissive {L}", 2, 0.9),
    # Bodies and notices of the Apache licence.
    ("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license", 1, 1.0),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1, 1.0),
    ("apache-2.0", "perpetual worldwide", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", 1, 1.0),
    ("apache-2.0", "licensed to the apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 1, 1.0),
    ("apache-", "apache", f"licensed under (?:the )?(?:terms of (?:the )?)?apache (?:software )?{L}{V}", 1, 1.0),
    ("apache-", "apache", f"(?:released|distributed|published|available|provided|offered) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?{L}{V}", 1, 1.0),
    ("apache-", "apache", f"apache (?:software )?{L}{V}", 2, 0.9),
    ("apache-", "apache", "apache(?: v| version)? v?[12] [01]", 2, 0.9),
    ("apache-2.0", "apache", "apache 2", 3, 0.8),
    ("apache-2.0", "apache", "(?:http|https) www apache org licenses license 2 0", 1, 1.0),
    ("apache", "apache", f"apache (?:software )?(?:foundation )?{L}", 4, 0.7),
    # GNU licences: notices, bodies, names.
    ("gpl", "general public", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public {L}", 1, 1.0),
    ("gpl", "general public", f"is free software you can redistribute it and or modify it under the terms of the gnu general public {L}", 1, 1.0),
    ("gpl-or-later", "any later version", "either version [23] of the license or at your option any later version", 1, 1.0),
    ("gpl", "copy of the gnu general public", f"you should have received a copy of the gnu general public {L} along with this", 1, 1.0),
    ("gpl", "licenses for most software", "the licenses for most software(?: and other practical works)? are designed to take away your freedom", 1, 1.0),
    ("gpl-3.0", "free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works", 1, 1.0),
    ("gpl-2.0", "copyright holder", "this license applies to any program or other work which contains a notice placed by the copyright holder", 1, 1.0),
    ("gpl", "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose", 2, 0.8),
    ("gpl-", "general public", f"licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public {L}{V}(?: or later| only)?", 1, 1.0),
    ("gpl-", "general public", f"(?:released|distributed|published|available|provided|offered|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public {L}{V}(?: or later| only)?", 1, 1.0),
    ("gpl-", "general public", f"(?:gnu )?general public {L}(?: gpl)?{V}(?: or later| only)?", 2, 0.9),
    ("gpl", "general public", f"(?:gnu )?general public {L}", 4, 0.7),
    ("gpl-", "gpl", f"(?:gnu )?gpl(?: {L})?{V}(?: or later| only)?", 2, 0.9),
    ("gpl-", "gplv", "gplv[123](?: [0-9])?(?: or later| only)?", 2, 0.9),
    ("gpl", "gpl", f"(?:gnu )?gpl(?: {L})?", 4, 0.7),
    ("gpl-classpath", "classpath", "(?:gnu )?(?:gpl )?(?:with )?(?:the )?classpath exception", 2, 0.9),
    ("gpl-classpath", "executable", "to link this library with independent modules to produce an executable", 1, 1.0),
    ("gpl-autoconf", "autoconf", "a configuration script generated by autoconf you may include it under the same distribution terms", 1, 1.0),
    ("gpl-gcc", "gcc", "gcc runtime library exception", 2, 0.9),
    ("gpl-font", "gpl", "gpl (?:with )?font exception", 3, 0.7),
    ("lgpl", "lesser general public", f"redistribute it and or modify it under the terms of the gnu lesser general public {L}", 1, 1.0),
    ("lgpl", "lesser general public", f"you should have received a copy of the gnu lesser general public {L}", 1, 1.0),
    ("lgpl-", "lesser general public", f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public {L}{V}(?: or later| only)?", 1, 1.0),
    ("lgpl-", "lesser general public", f"(?:gnu )?lesser general public {L}(?: lgpl)?{V}(?: or later| only)?", 2, 0.9),
    ("lgpl", "lesser general public", f"(?:gnu )?lesser general public {L}", 3, 0.8),
    ("lgpl", "library general public", f"under the terms of the gnu library general public {L}", 1, 1.0),
    ("lgpl-", "library general public", f"(?:gnu )?library general public {L}{V}(?: or later| only)?", 2, 0.9),
    ("lgpl", "library general public", f"(?:gnu )?library general public {L}", 3, 0.8),
    ("lgpl-", "lgpl", f"(?:gnu )?lgpl(?: {L})?{V}(?: or later| only)?", 2, 0.9),
    ("lgpl-", "lgplv", "lgplv[23](?: [0-9])?(?: or later| only)?", 2, 0.9),
    ("lgpl", "lgpl", f"(?:gnu )?lgpl(?: {L})?", 4, 0.7),
    ("agpl", "affero general public", f"redistribute it and or modify it under the terms of the gnu affero general public {L}", 1, 1.0),
    ("agpl", "remotely", "users interacting with it remotely through a computer network", 1, 1.0),
    ("agpl-", "affero general public", f"(?:gnu )?affero general public {L}(?: agpl)?{V}(?: or later| only)?", 2, 0.9),
    ("agpl", "affero general public", f"(?:gnu )?affero general public {L}", 3, 0.8),
    ("agpl-", "agpl", f"(?:gnu )?agpl(?: {L})?{V}(?: or later| only)?", 2, 0.9),
    ("agpl-", "agplv", "agplv[13](?: [0-9])?(?: or later| only)?", 2, 0.9),
    ("agpl", "agpl", f"(?:gnu )?agpl(?: {L})?", 4, 0.7),
    ("gfdl", "free documentation", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}", 1, 1.0),
    ("gfdl-", "free documentation", f"(?:gnu )?free documentation {L}{V}(?: or later)?", 2, 0.9),
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {L}", 3, 0.8),
    ("gfdl", "invariant sections", "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts", 1, 1.0),
    # Other weak and strong copyleft.
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("mpl-", "mozilla public", f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mozilla public {L}{V}", 1, 1.0),
    ("mpl-", "mozilla public", f"mozilla public {L}(?: mpl)?{V}", 2, 0.9),
    ("mpl", "mozilla public", f"mozilla public {L}", 3, 0.8),
    ("npl", "netscape public", f"netscape public {L}(?:{V})?", 2, 0.9),
    ("epl", "eclipse public", f"this program and the accompanying materials are made available under the terms of the eclipse public {L}", 1, 1.0),
    ("epl-", "eclipse public", f"eclipse public {L}{V}", 2, 0.9),
    ("epl", "eclipse public", f"eclipse public {L}", 3, 0.8),
    ("edl-", "eclipse distribution", f"eclipse distribution {L}{V}", 2, 0.9),
    ("edl", "eclipse distribution", f"eclipse distribution {L}", 3, 0.8),
    ("cpl-", "common public", f"common public {L}{V}", 2, 0.9),
    ("cpl", "common public", f"common public {L}", 3, 0.8),
    ("cpal", "common public attribution", f"common public attribution {L}(?:{V})?", 2, 0.9),
    ("ipl", "ibm public", f"ibm public {L}(?:{V})?", 2, 0.9),
    ("cddl", "common development and distribution", f"the contents of this file are subject to the terms of the common development and distribution {L}", 1, 1.0),
    ("cddl-", "common development and distribution", f"common development and distribution {L}(?: cddl)?{V}", 2, 0.9),
    ("cddl", "common development and distribution", f"common development and distribution {L}", 3, 0.8),
    ("cddl-", "cddl", f"cddl(?: {L})?{V}", 2, 0.9),
    ("spl", "sun public", f"sun public {L}(?:{V})?", 2, 0.9),
    ("apsl-", "apple public source", f"apple public source {L}{V}", 2, 0.9),
    ("apsl", "apple public source", f"apple public source {L}", 3, 0.8),
    ("eupl", "european union public", f"licen[cs]ed under the european union public {L}", 1, 1.0),
    ("eupl", "eupl", "licen[cs]ed under the eupl", 1, 1.0),
    ("eupl-", "european union public", f"european union public {L}{V}", 2, 0.9),
    ("eupl", "european union public", f"european union public {L}", 3, 0.8),
    ("osl-", "open software", f"(?:licensed under the )?open software {L}{V}", 2, 0.9),
    ("osl", "open software", f"open software {L}", 4, 0.6),
    ("afl-", "academic free", f"(?:licensed under the )?academic free {L}{V}", 2, 0.9),
    ("afl", "academic free", f"academic free {L}", 3, 0.8),
    ("artistic-", "artistic", f"artistic {L}{V}", 2, 0.9),
    ("artistic", "artistic", f"artistic {L}", 3, 0.8),
    ("artistic", "artistic control", "the copyright holder maintains some semblance of artistic control over the development of the package", 1, 1.0),
    ("perl", "perl", "under the same terms as perl (?:itself|5)", 1, 1.0),
    ("ruby", "ruby", "under the same terms as ruby", 1, 1.0),
    ("ruby", "ruby", f"ruby {L}", 3, 0.8),
    ("qpl", "q public", f"q public {L}(?:{V})?", 2, 0.9),
    ("sspl", "server side public", f"server side public {L}(?:{V})?", 2, 0.9),
    ("busl", "business source", f"business source {L}(?:{V})?", 2, 0.9),
    ("busl", "hereby grants", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1, 1.0),
    ("elastic", "elastic", f"elastic {L}(?:{V})?", 2, 0.9),
    ("commons-clause", "commons clause", f"commons clause(?: {L})?(?: condition)?", 2, 0.9),
    ("polyform", "polyform", f"polyform (?:noncommercial|small business|shield|strict|internal use|perimeter|free trial) {L}(?:{V})?", 2, 0.9),
    ("parity", "parity public", f"parity public {L}(?:{V})?", 2, 0.9),
    ("cecill-", "cecill", f"cecill(?: {L})?{V}", 2, 0.9),
    ("cecill-b", "cecill b", f"cecill b(?: (?:free software )?{L})?(?: agreement)?", 2, 0.9),
    ("cecill-c", "cecill c", f"cecill c(?: (?:free software )?{L})?(?: agreement)?", 2, 0.9),
    ("cecill", "cecill", f"cecill(?: {L})?", 3, 0.8),
    ("ms-pl", "microsoft public", f"microsoft public {L}(?: ms pl)?", 2, 0.9),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {L}(?: ms rl)?", 2, 0.9),
    ("watcom", "sybase open watcom", f"sybase open watcom public {L}", 2, 0.9),
    ("rpl", "reciprocal public", f"reciprocal public {L}(?:{V})?", 2, 0.9),
    ("nposl", "non profit open software", f"non profit open software {L}(?:{V})?", 2, 0.9),
    ("lppl", "latex project public", f"latex project public {L}(?:{V})?", 2, 0.9),
    ("lppl", "latex project public", f"this work may be distributed and or modified under the conditions of the latex project public {L}", 1, 1.0),
    ("zpl", "zope public", f"zope public {L}(?:{V})?", 2, 0.9),
    ("sleepycat", "sleepycat", f"sleepycat {L}", 2, 0.9),
    ("ecl", "educational community", f"educational community {L}(?:{V})?", 2, 0.9),
    ("efl", "eiffel forum", f"eiffel forum {L}(?:{V})?", 2, 0.9),
    ("entessa", "entessa public", f"entessa public {L}", 2, 0.9),
    ("intel", "intel open source", f"intel open source {L}", 2, 0.9),
    ("motosoto", "motosoto open source", f"motosoto open source {L}", 2, 0.9),
    ("nokia", "nokia open source", f"nokia open source {L}", 2, 0.9),
    ("oclc", "oclc research", f"oclc research public {L}(?:{V})?", 2, 0.9),
    ("sissl", "sun industry standards", f"sun industry standards source {L}(?:{V})?", 2, 0.9),
    ("vsl", "vovida software", f"vovida software {L}(?:{V})?", 2, 0.9),
    ("xnet", "x net", f"x net {L}", 2, 0.9),
    ("mulan", "mulan", f"mulan (?:permissive software|public) {L}(?:{V})?", 2, 0.9),
    ("blueoak", "blue oak", f"blue oak model {L}(?:{V})?", 2, 0.9),
    ("cal", "cryptographic autonomy", f"cryptographic autonomy {L}(?:{V})?", 2, 0.9),
    ("hippocratic", "hippocratic", f"hippocratic {L}(?:{V})?", 2, 0.9),
    ("jrl", "java research", f"java research {L}", 2, 0.9),
    ("bcl", "binary code license", "(?:oracle |sun )?binary code license agreement", 2, 0.9),
    # Names of permissive licences.
    ("mit", "mit", f"licensed under (?:the )?(?:terms of (?:the )?)?mit(?: {L})?", 1, 1.0),
    ("mit", "mit", f"(?:released|distributed|published|available|provided|offered) under (?:the )?(?:terms of (?:the )?)?mit {L}", 1, 1.0),
    ("mit", "mit", f"(?:the )?mit(?: expat)? {L}", 3, 0.8),
    ("mit", "mit", f"{L} mit", 3, 0.8),
    ("x11", "x11", f"(?:mit )?x11 {L}", 3, 0.8),
    ("isc", "isc", f"(?:licensed under (?:the )?)?isc {L}", 3, 0.8),
    ("bsd-2-clause", "bsd", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: {L})?", 2, 0.9),
    ("bsd-3-clause", "bsd", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: {L})?", 2, 0.9),
    ("bsd-4-clause", "bsd", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: {L})?", 2, 0.9),
    ("bsd-0-clause", "bsd", f"(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)(?: {L})?", 2, 0.9),
    ("bsd-2-clause", "bsd", f"(?:simplified|freebsd) bsd {L}", 2, 0.9),
    ("bsd-3-clause", "bsd", f"(?:new|modified|revised) bsd {L}", 2, 0.9),
    ("bsd-4-clause", "bsd", f"(?:original|old) bsd {L}", 2, 0.9),
    ("bsd", "bsd", f"(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? {L}", 1, 1.0),
    ("bsd", "bsd style", f"governed by a bsd style {L}", 1, 1.0),
    ("bsd", "bsd", f"bsd(?: style| like)? {L}", 3, 0.8),
    ("bsd", "bsd", "bsd(?: style| like)?", 4, 0.5),
    ("zlib", "zlib", f"zlib(?: libpng)? {L}", 3, 0.8),
    ("libpng", "libpng", f"libpng {L}", 3, 0.8),
    ("bsl-", "boost software", f"(?:distributed under the )?boost software {L}{V}", 2, 0.9),
    ("bsl", "boost software", f"boost software {L}", 3, 0.8),
    ("unlicense", "unlicense", "(?:released under )?the unlicense", 2, 0.9),
    ("wtfpl", "wtfpl", f"wtfpl(?:{V})?", 2, 0.9),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {L}", 2, 0.9),
    ("postgresql", "postgresql", f"postgresql {L}", 3, 0.8),
    ("openssl", "openssl", f"openssl {L}", 3, 0.8),
    ("php", "php", f"php {L}(?:{V})?", 3, 0.8),
    ("vim", "vim", f"vim {L}", 3, 0.8),
    ("python", "python", f"python {L}", 3, 0.8),
    ("psf", "psf", f"psf {L}(?:{V})?", 3, 0.8),
    ("ofl-", "open font", f"(?:sil )?open font {L}{V}", 2, 0.9),
    ("ofl", "open font", f"(?:sil )?open font {L}", 3, 0.8),
    # Creative Commons and data licences.
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 2, 0.9),
    ("cc0", "creative commons", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?", 1, 1.0),
    ("cc0", "waived all copyright", "has waived all copyright and related or neighboring rights to this work", 1, 1.0),
    ("cc", "licensed under a creative commons", f"this work is licensed under a creative commons {L}", 1, 1.0),
    ("cc-by-", "creative commons", f"creative commons attribution{V}(?: international| unported| generic)?(?: {L})?", 1, 1.0),
    ("cc-by-sa-", "creative commons", f"creative commons attribution share ?alike{V}(?: international| unported| generic)?(?: {L})?", 1, 1.0),
    ("cc-by-nd-", "creative commons", f"creative commons attribution no ?deriv(?:ative)?s?{V}(?: international| unported| generic)?(?: {L})?", 1, 1.0),
    ("cc-by-nc-", "creative commons", f"creative commons attribution non ?commercial{V}(?: international| unported| generic)?(?: {L})?", 1, 1.0),
    ("cc-by-nc-sa-", "creative commons", f"creative commons attribution non ?commercial share ?alike{V}(?: international| unported| generic)?(?: {L})?", 1, 1.0),
    ("cc-by-nc-nd-", "creative commons", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s?{V}(?: international| unported| generic)?(?: {L})?", 1, 1.0),
    ("cc-by", "creative commons", f"creative commons attribution(?: {L})?", 2, 0.9),
    ("cc-by-sa", "creative commons", f"creative commons attribution share ?alike(?: {L})?", 2, 0.9),
    ("cc-by-nd", "creative commons", f"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: {L})?", 2, 0.9),
    ("cc-by-nc", "creative commons", f"creative commons attribution non ?commercial(?: {L})?", 2, 0.9),
    ("cc-by-nc-sa", "creative commons", f"creative commons attribution non ?commercial share ?alike(?: {L})?", 2, 0.9),
    ("cc-by-nc-nd", "creative commons", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: {L})?", 2, 0.9),
    ("cc", "creative commons", f"creative commons(?: {L})?", 4, 0.6),
    ("cc-by-", "cc by", "(?:licensed under )?cc by [1-4] [05](?: international| unported)?", 1, 1.0),
    ("cc-by-sa-", "cc by sa", "cc by sa [1-4] [05](?: international| unported)?", 1, 1.0),
    ("cc-by-nd-", "cc by nd", "cc by nd [1-4] [05](?: international| unported)?", 1, 1.0),
    ("cc-by-nc-", "cc by nc", "cc by nc [1-4] [05](?: international| unported)?", 1, 1.0),
    ("cc-by-nc-sa-", "cc by nc sa", "cc by nc sa [1-4] [05](?: international| unported)?", 1, 1.0),
    ("cc-by-nc-nd-", "cc by nc nd", "cc by nc nd [1-4] [05](?: international| unported)?", 1, 1.0),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", 2, 0.9),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", 2, 0.9),
    ("cc-by-sa", "cc by sa", "cc by sa", 2, 0.9),
    ("cc-by-nd", "cc by nd", "cc by nd", 2, 0.9),
    ("cc-by-nc", "cc by nc", "cc by nc", 2, 0.9),
    ("cc-by", "cc by", "cc by", 4, 0.7),
    ("cc", "creativecommons org", "creativecommons org (?:licenses|publicdomain) (?:by|by sa|by nd|by nc|by nc sa|by nc nd|zero) [0-9] [0-9]", 1, 1.0),
    ("odbl-", "open database", f"(?:open data commons )?open database {L}(?: odbl)?{V}", 2, 0.9),
    ("odbl", "open database", f"(?:open data commons )?open database {L}", 3, 0.8),
    ("odbl", "odbl", f"odbl(?:{V})?", 3, 0.8),
    ("odc-by", "open data commons", f"open data commons attribution {L}(?:{V})?", 2, 0.9),
    ("pddl", "open data commons", f"open data commons public domain dedication(?: and {L})?(?:{V})?", 2, 0.9),
    ("cdla", "community data", f"community data {L} agreement (?:permissive|sharing)(?:{V})?", 2, 0.9),
    ("ogl", "open government", f"open government {L}(?:{V})?", 2, 0.9),
    ("ogl", "public sector information licensed", f"contains public sector information licensed under the open government {L}", 1, 1.0),
    ("openrail", "openrail", f"(?:creativeml |bigscience )?openrail(?: m| s)?(?: {L})?", 3, 0.8),
    ("llama", "llama", f"llama [0-9](?: [0-9])? community {L}(?: agreement)?", 2, 0.9),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put|donated) (?:in|into|to) the public domain", 2, 0.9),
    ("public-domain", "public domain", "this (?:work|file|software|code|document) is (?:in|hereby placed in|part of) the public domain", 1, 1.0),
    ("public-domain", "public domain", "public domain", 4, 0.7),
    ("public-domain", "no known copyright", "no known copyright restrictions", 3, 0.7),
    # Identifiers.
    ("apache-", "spdx", "spdx license identifier apache [12] [01]", 1, 1.0),
    ("mit", "spdx", "spdx license identifier mit", 1, 1.0),
    ("bsd-2-clause", "spdx", "spdx license identifier bsd 2 clause", 1, 1.0),
    ("bsd-3-clause", "spdx", "spdx license identifier bsd 3 clause", 1, 1.0),
    ("isc", "spdx", "spdx license identifier isc", 1, 1.0),
    ("gpl-", "spdx", "spdx license identifier gpl [123] [0-9](?: only| or later)?", 1, 1.0),
    ("lgpl-", "spdx", "spdx license identifier lgpl [23] [0-9](?: only| or later)?", 1, 1.0),
    ("agpl-", "spdx", "spdx license identifier agpl [13] [0-9](?: only| or later)?", 1, 1.0),
    ("mpl-", "spdx", "spdx license identifier mpl [12] [0-9]", 1, 1.0),
    ("epl-", "spdx", "spdx license identifier epl [12] [0-9]", 1, 1.0),
    ("cddl-", "spdx", "spdx license identifier cddl 1 [01]", 1, 1.0),
    ("bsl-", "spdx", "spdx license identifier bsl 1 0", 1, 1.0),
    ("zlib", "spdx", "spdx license identifier zlib", 1, 1.0),
    ("unlicense", "spdx", "spdx license identifier unlicense", 1, 1.0),
    ("cc0", "spdx", "spdx license identifier cc0 1 0", 1, 1.0),
    ("cc-by-", "spdx", "spdx license identifier cc by [1-4] [05]", 1, 1.0),
    ("cc-by-sa-", "spdx", "spdx license identifier cc by sa [1-4] [05]", 1, 1.0),
    ("spdx", "spdx", "spdx license identifier", 3, 0.6),
    # Notices that name no licence.
    ("reserved", "reserved", "all rights reserved", 3, 0.6),
    ("reserved", "reserved", "some rights reserved", 3, 0.6),
    ("reserved", "reservados", "todos los derechos reservados", 3, 0.6),
    ("reserved", "vorbehalten", "alle rechte vorbehalten", 3, 0.6),
    ("reserved", "tous droits", "tous droits r[eé]serv[eé]s", 3, 0.6),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", 3, 0.6),
    ("copyright", "copyright", "(?:c )?copyright by", 3, 0.6),
    ("copyright", "copyright", "copyright (?:c|holder|holders|owner|notice)", 4, 0.6),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 2, 0.9),
    ("proprietary", "trade secrets", "contains (?:confidential information and |proprietary information and )?trade secrets of", 2, 0.9),
    ("no-copying", "strictly prohibited", "unauthori[sz]ed copying of this file .{0,60}?strictly prohibited", 2, 0.9),
    ("no-copying", "may be reproduced", "no part of this (?:publication|book|work|document) may be reproduced", 2, 0.9),
    ("no-copying", "may not be reproduced", "may not be reproduced (?:or distributed |copied |in whole or in part )?without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)", 2, 0.9),
    ("non-commercial", "non commercial use only", "for (?:personal and )?non commercial use only", 2, 0.8),
    ("evaluation", "evaluation purposes only", "for evaluation purposes only", 3, 0.7),
    ("eula", "end user", f"end user {L} agreement", 3, 0.7),
    ("see-license", "see the license", "see the license file (?:in|for|at)", 3, 0.6),
    ("no-warranty", "without warranty of any kind", "without warranty of any kind", 4, 0.5),
]
