import sys

from gleanery.cli import main

sys.exit(main())
