import sys

from vellum.cli import main

sys.exit(main())
