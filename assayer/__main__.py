import sys

from assayer.cli import main

sys.exit(main())
