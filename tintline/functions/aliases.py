"""Other names that users know: functions with width-aware options, and those for formats only.

Those ending in 2 are the same functions as without it, whose options they share; those
ending in sgr treat SGR sequences alone as controls, as the names did before ``ctl``.
"""

from __future__ import annotations

from functools import partial

from .html import to_html
from .text import strsplit_ctl, strtrim_ctl, strwrap_ctl, substr_ctl

substr2_ctl, strtrim2_ctl, strwrap2_ctl = substr_ctl, strtrim_ctl, strwrap_ctl
substr_sgr = partial(substr_ctl, ctl="sgr")
substr2_sgr = partial(substr_ctl, ctl=("sgr", "url"))
strtrim_sgr = strtrim2_sgr = partial(strtrim_ctl, ctl="sgr")
strwrap_sgr = strwrap2_sgr = partial(strwrap_ctl, ctl="sgr")
strsplit_sgr = partial(strsplit_ctl, ctl="sgr")
sgr_to_html = to_html
