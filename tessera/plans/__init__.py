"""The driver's tables as tensor sets, and the registered queries over them."""
