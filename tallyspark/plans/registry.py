"""All registered queries of the statement engine with their SQL."""

from __future__ import annotations

from .accounts import QUERIES as _A
from .accounts import SQL as _AS
from .anchorqueries import QUERIES as _N
from .anchorqueries import SQL as _NS
from .cascadelayouts import QUERIES as _C
from .cascadelayouts import SQL as _CS
from .detectors import QUERIES as _D
from .detectors import SQL as _DS
from .extras import QUERIES as _X
from .extras import SQL as _XS
from .layouts import QUERIES as _Y
from .layouts import SQL as _YS
from .markerlayouts import QUERIES as _M
from .markerlayouts import SQL as _MS
from .noteparties import QUERIES as _Q
from .noteparties import SQL as _QS
from .parties import QUERIES as _P
from .parties import SQL as _PS
from .scalars import QUERIES as _F
from .scalars import SQL as _FS
from .wordlayouts import QUERIES as _W
from .wordlayouts import SQL as _WS

QUERIES: dict = _F | _D | _A | _X | _P | _Y | _W | _C | _N | _M | _Q
ORACLE_SQL: dict[str, str] = _FS | _DS | _AS | _XS | _PS | _YS | _WS | _CS | _NS | _MS | _QS
