"""Templates of licence texts and standard file headers, as (license, text); of long licences, their titles and first paragraphs."""

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_APACHE_HEAD = (
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
    "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "
    "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."
)
_FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GPL_3_HEAD = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> " + _FSF + " Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."
_AGPL_3_HEAD = "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> " + _FSF + " Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."
_LGPL_3_HEAD = "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> " + _FSF + " This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."
_GPL_2_HEAD = "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _FSF + " Preamble The licenses for most software are designed to take away your freedom to share and change it."
_LGPL_2_HEAD = "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _FSF + " This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_MPL_HEAD = "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ENDS = (
    "along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "along with this program; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA.",
)


def _header(name: str, version: str, thing: str, end: str) -> str:
    return (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} {end.replace('program', thing)}"
    )


_GNU = (("GPL-3.0", "GNU General Public License", "3", "program"), ("GPL-2.0", "GNU General Public License", "2", "program"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"), ("LGPL-3.0", "GNU Lesser General Public License", "3", "library"), ("AGPL-3.0", "GNU Affero General Public License", "3", "program"))
TEXTS = (
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE_HEAD), ("MIT", _MIT), ("ISC", _ISC), ("BSD-3-Clause", _BSD_3 + _BSD_END), ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("GPL-3.0", _GPL_3_HEAD), ("AGPL-3.0", _AGPL_3_HEAD), ("LGPL-3.0", _LGPL_3_HEAD), ("GPL-2.0", _GPL_2_HEAD), ("LGPL-2.1", _LGPL_2_HEAD), ("MPL-2.0", _MPL), ("MPL-2.0", _MPL_HEAD), ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    *((license, _header(name, version, thing, end)) for license, name, version, thing in _GNU for end in _ENDS),
)
