"""Clients that tests reach by name, in workers as well."""

import os

from millrace.sources import connectors


class Shaky:
    """A client of as many items as a file says; the first calls of each number fail, as other files remember."""

    def __init__(self, options):
        self.folder, self.fails = options["folder"], int(options.get("fails", 0))
        self.kind = options.get("kind", "error")

    def count(self):
        with open(f"{self.folder}/count") as f:
            return int(f.read())

    def items(self, first, last):
        path = f"{self.folder}/tried-{first}"
        tried = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if tried < self.fails:
            raise {"error": OSError, "limit": lambda: connectors.RateLimited(0.01), "quota": connectors.QuotaSpent}[self.kind]()
        return [{"n": i, "url": f"u{i}"} for i in range(first, last)]
