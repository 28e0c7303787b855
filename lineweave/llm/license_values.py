"""Licence sentences and rules of the licence scan: fixed values."""

# Sentences of public licences, as their texts and usual notices have them.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    3: "you may not use this file except in compliance with the License",
    4: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    5: "Unless required by applicable law or agreed to in writing, software distributed under the License is "
       "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    6: "See the License for the specific language governing permissions and limitations under the License",
    10: "Released under the MIT License",
    11: "Licensed under the MIT License",
    12: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    13: "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software",
    14: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    15: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer",
    22: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution",
    23: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    24: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    25: "nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission",
    30: "This work is licensed under the GNU General Public License, version 3",
    31: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    32: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    33: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    34: "See the GNU General Public License for more details",
    35: "You should have received a copy of the GNU General Public License along with this program",
    36: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation",
    37: "either version 2 of the License, or (at your option) any later version",
    38: "either version 3 of the License, or (at your option) any later version",
    39: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
        "published by the Free Software Foundation",
    40: "Licensed under CC BY-NC 4.0",
    41: "Licensed under CC BY 4.0",
    42: "Licensed under CC BY-SA 4.0",
    43: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    44: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    45: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    46: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation",
    47: "either version 2.1 of the License, or (at your option) any later version",
    48: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    49: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    51: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    52: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    53: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    54: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    55: "This is free and unencumbered software released into the public domain",
    56: "This software is provided 'as-is', without any express or implied warranty",
    57: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions",
    58: "Distributed under the Boost Software License, Version 1.0",
    59: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    60: "All rights reserved",
    61: "SPDX-License-Identifier",
    62: "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    63: "Version 2.0, January 2004",
    64: "GNU GENERAL PUBLIC LICENSE",
    65: "Version 3, 29 June 2007",
    66: "Version 2, June 1991",
    67: "GNU LESSER GENERAL PUBLIC LICENSE",
    68: "Version 2.1, February 1999",
    69: "GNU AFFERO GENERAL PUBLIC LICENSE",
    70: "Version 3, 19 November 2007",
}

# Identifiers that may follow an SPDX-License-Identifier; they are sentences 101 and on.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "MPL-2.0",
        "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {101 + n: name for n, name in enumerate(SPDX)}

# What stands for a holder's name in a normalised sentence, and the sentence as it is known.
HOLDERS = (r"^neither the name of .+ nor the names of (its|their|any|other) (contributors|its contributors) may",
           "neither the name of the copyright holder nor the names of its contributors may")

# Fixed values: (licence, kind, sentence ids in order); an earlier rule goes before a later one.
RULES = [
    *((name, "spdx", (61, 101 + n)) for n, name in enumerate(SPDX)),
    ("Apache-2.0", "text", (63, 62)),
    ("LGPL-2.1", "text", (67, 68)),
    ("LGPL-3.0", "text", (67, 65)),
    ("AGPL-3.0", "text", (69, 70)),
    ("GPL-3.0", "text", (64, 65)),
    ("GPL-2.0", "text", (64, 66)),
    ("BSD-4-Clause", "text", (20, 21, 22, 24, 23)),
    ("BSD-4-Clause", "text", (20, 21, 22, 24, 25)),
    ("BSD-3-Clause", "text", (20, 21, 22, 23)),
    ("BSD-3-Clause", "text", (20, 21, 22, 25)),
    ("BSD-2-Clause", "text", (20, 21, 22)),
    ("MIT", "text", (12, 13, 14, 15)),
    ("MIT", "text", (12, 13, 14)),
    ("MIT", "text", (12, 13)),
    ("Apache-2.0", "header", (2, 3, 4, 5, 6)),
    ("Apache-2.0", "header", (2, 3, 4, 5)),
    ("Apache-2.0", "header", (2, 3, 4)),
    ("GPL-3.0-or-later", "header", (31, 32, 33, 34, 35)),
    ("GPL-3.0-or-later", "header", (31, 32, 33, 34)),
    ("GPL-2.0-or-later", "header", (36, 37)),
    ("GPL-3.0-or-later", "header", (36, 38)),
    ("LGPL-2.1-or-later", "header", (46, 47)),
    ("LGPL-3.0-or-later", "header", (46, 38)),
    ("GPL-2.0-only", "header", (39,)),
    ("LGPL-3.0-or-later", "header", (48,)),
    ("AGPL-3.0-or-later", "header", (49,)),
    ("ISC", "text", (52,)),
    ("ISC", "text", (53,)),
    ("0BSD", "text", (54,)),
    ("Unlicense", "text", (55,)),
    ("Zlib", "text", (56, 57)),
    ("Zlib", "text", (57,)),
    ("BSL-1.0", "notice", (58,)),
    ("EPL-2.0", "header", (59,)),
    ("MPL-2.0", "header", (50, 51)),
    ("GPL-3.0-or-later", "notice", (31,)),
    ("Apache-2.0", "notice", (1,)),
    ("Apache-2.0", "notice", (2,)),
    ("MIT", "notice", (10,)),
    ("MIT", "notice", (11,)),
    ("MIT", "notice", (12,)),
    ("GPL-3.0-only", "notice", (30,)),
    ("CC-BY-NC-4.0", "notice", (40,)),
    ("CC-BY-4.0", "notice", (41,)),
    ("CC-BY-SA-4.0", "notice", (42,)),
    ("CC-BY-4.0", "notice", (43,)),
    ("CC-BY-SA-4.0", "notice", (44,)),
    ("CC-BY-NC-4.0", "notice", (45,)),
    ("MPL-2.0", "notice", (50,)),
    ("LicenseRef-all-rights-reserved", "notice", (60,)),
]
