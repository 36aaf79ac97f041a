"""Analytics over typed, bi-temporal knowledge graphs, as lazy DataFrame builders."""
