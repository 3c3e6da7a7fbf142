import sys

from strandlake.cli import main

sys.exit(main())
