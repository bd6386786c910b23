"""Named queries over the test tables, each with equivalent SQL where SQL can express it."""
