from __future__ import annotations

import pytest

from priorline.llm import leaks


@pytest.mark.parametrize("n", [9, 14, 19, 54])
def test_a_copy_that_lacks_exactly_a_fifth_is_found(n):
    item = [f"word{i}" for i in range(n)]
    index = leaks.build_index([(7, " ".join(item)), *((100 + k, " ".join(f"other{k}x{i}" for i in range(n))) for k in range(20))])
    cut = (n - 4) // 5
    for copy in (item[cut:], item[:-cut]):
        found = leaks.leaks_in(index, [" ".join(["before", *copy, "after"]).encode()])[0]
        assert [index.ids[i] for i in found] == [7]
