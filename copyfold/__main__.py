"""``python -m copyfold``: see copyfold.plans.files.main."""

import sys

from copyfold.plans.files import main

if __name__ == "__main__":
    sys.exit(main())
