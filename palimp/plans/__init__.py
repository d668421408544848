"""Named queries over the standard tables, each with its SQL equivalent where SQL can say it."""
