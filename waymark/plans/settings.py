"""What the queries take as given about one data set; for another one only this module changes."""

from __future__ import annotations

#: Regions by the names of their municipalities, in the order in which they are tried, and the region of all others.
REGIONS = {"東信": ("柏霧", "桂雲", "鶴霜"), "北信": ("霧嶺", "朱岳", "藍沼"), "中信": ("樺見", "月杉", "雁原")}
OTHER_REGION, NO_REGION = "南信", "未分類"
#: Municipalities that are known without being looked up.
KNOWN_PLACES = ("霧嶺市",)
#: Hosts of official pages, and of boards, whose pages are no evidence.
OFFICIAL_HOSTS = r"(-town|-archive)\.example$|^(www\.)?(mori|tani)-"
BOARD_HOSTS = r"-(bbs|board)\."


def quoted(values: tuple[str, ...]) -> str:
    """SQL list of texts."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
